"""The pipeline's stages, one after the other, and its queries' registration."""

import random
from pathlib import Path

import corpus_pipeline
from kinweave.llm import common, queries


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(60)) for _ in range(300)]
    texts = [t + (" vile" if i % 10 == 0 else "") for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i].replace(" ", "  "), "en", "s0", 0) for i in range(1, 60)] + [(2000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    clean = {i for i in range(300) if i % 10} | {2000}
    assert set(kept["toxicity"]) == clean | {1000 + i for i in range(1, 60) if i % 10}
    assert sorted(kept["exact_dedup"]) == sorted([i + 1000 if 1 <= i < 60 else i for i in clean])
    assert sorted(kept["near_dedup"]) == sorted(kept["exact_dedup"]) and set(kept["mix"]) <= set(kept["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept["mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, row_id long, doc string, kept boolean, key string, h1 long, best int"


def test_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, very long texts, and columns of clashing names go through all stages."""
    rng = random.Random(16)
    extra = (1, 2, "d", True, "k", 3, 4)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(80)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), *extra) for i, t in enumerate(texts)]
    rows += [(None, texts[0] + " x", None, None, None, *extra)] * 3 + [(5, texts[5], "en", "s2", 9, *extra)] * 2
    rows += [(None, None, None, None, None, *extra), (50, "", None, "s1", 0, *extra), (51, " \n", None, "s1", 2, *extra), (52, None, "en", None, None, *extra)]
    rows += [(53, " ".join(f"v{rng.randint(0, 9000)}" for _ in range(60_000)), "en", "s1", 1, *extra), (54, "x" * 200_000, "en", "s1", 1, *extra)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in docs.collect()))
    assert kept["toxicity"] == sorted(r[0] if r[0] is not None else -1 for r in rows)
    blank = 51  # of null, empty and blank texts the longest original
    assert kept["exact_dedup"] == sorted([-1, *range(40), blank, 53, 54])
    assert kept["near_dedup"] == sorted([*range(40), blank, 53, 54])  # the row without an id is near document 0
    assert set(kept["mix"]) <= {*range(40), 53, 54}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept["mix"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_is_not_needed_goes(spark, tmp_path):
    """Only tables that were written on the way are deleted."""
    one, path = common.written_at(spark.range(5))
    own = f"{tmp_path}/{common.WRITTEN}own"
    spark.range(3).write.parquet(own)
    folder = Path(one.inputFiles()[0].removeprefix("file:")).parent
    assert folder.is_dir()
    common.forget(spark, path)
    common.forget(spark, own)
    assert not folder.exists() and spark.read.parquet(own).count() == 3


def test_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)


def test_only_what_run_wrote_is_deleted(spark, tmp_path, monkeypatch):
    """Input in single files in a folder named like those of the run stays; of the tables on the way only the last is left."""
    data, shared = tmp_path / "kinweave-data", tmp_path / "shared"
    data.mkdir()
    for name, rows, schema in (("documents", [(i, f"one two three {i} five six", "en", "s", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long"), ("labels", [(i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(data / f"{name}.parquet", index=False)
    before = {p.name: p.stat().st_size for p in data.iterdir()}
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{shared}")
    corpus_pipeline.run(spark, str(data)).count()
    assert {p.name: p.stat().st_size for p in data.iterdir()} == before
    left = [p for p in shared.iterdir() if "source" in spark.read.parquet(str(p)).columns and "text" in spark.read.parquet(str(p)).columns]
    assert len(left) == 1
    common.forget(spark, str(data))
    common.forget(spark, None)
    assert {p.name for p in data.iterdir()} == set(before)
