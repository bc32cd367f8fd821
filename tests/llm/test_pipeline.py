"""The pipeline's stages, each against plain Python over its own input."""

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from parcela.llm.fragments import FragmentEncoder

from test_jaccard import grams
from test_lines import plain_base, plain_dedup
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen, kept_frames = [], []
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        kept_frames.append(docs)
        after = docs.collect()
        seen.append(len(after))
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
            kept = {r.doc_id: r for r in after}
            assert len(kept) == len(after) and kept.keys() <= before.keys()
        if name.startswith("quality"):
            if name == "quality rules":
                assert not any(plain_base(r.text)[5] for r in after)
                wanted = {d for d, r in before.items() if not plain_base(r.text)[5] and labels.get(d) == 1}
            else:
                wanted = {d for d in before if labels.get(d) == 1}
            assert len(wanted - kept.keys()) <= 0.02 * len(wanted)
        elif name == "line dedup":
            import hashlib
            want = plain_dedup([(d, r.text) for d, r in before.items()])
            assert sorted(eval(x)[0::3] for x in want) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near duplicates":
            sets = {d: grams(r.text, 5) for d, r in before.items()}
            near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
            parent = {d: d for d in sets}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x
            for a in sets:
                for b in sets:
                    if a < b and near(sets[a], sets[b]):
                        parent[max(find(a), find(b))] = min(find(a), find(b))
            assert kept.keys() == {d for d in sets if find(d) == d}
        elif name == "packing":
            lib = FragmentEncoder("word_bpe_49k.json").library
            assert check_packing([r.asDict() for r in after], {d: lib.encode(r.text, add_special_tokens=False).ids + [1] for d, r in before.items()}) == 0
    assert seen[3] > 50
    for frame in kept_frames:
        frame.unpersist()


def test_run_and_edges(spark):
    assert entry.queries()["pipeline"] is pipeline.run
    assert set(pipeline.run(spark, SF).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "word " * 60, "en", "s", 5), (2, "", "en", None, 0)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in pipeline.STAGES:
            rows = stage(spark, rows, SF)
            rows.collect()
