"""Fill-in-middle against cutting with Python's regular expressions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from kinweave.llm import infill

SPACE = "\x20\x09-\x0d"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SCHEMA = "doc_id long, text string, n long, form string, marked string, h1 long, prefix string"


def cut(doc_id, text):
    """(n, form, prefix, middle, suffix, output)."""
    text = text or ""
    units = UNIT.findall(text)
    n, hex_ = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex_[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_as_by_brute_force(spark):
    rng = random.Random(9)
    bits = ["a", "word", " ", "  ", "\n", "\t\x0b", "\x01", "\x02", "e", "m", "\x02m", "\x01e", "é", "🙂", " ", "\x1c", "$1", "\\", "<", "<P", "S>", "<M"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(700 + i, f"has {x} inside") for i, x in enumerate(("<P>", "<S>", "<M>", "<P><S><M>"))]
    rows += [(800, None), (801, ""), (802, "   "), (None, "no id at all"), (None, "no id at all"), rows[0], rows[0], (2**60, "x " * 200_000), *((900 + i, "\x02\x01\x02m\x02e " * 9) for i in range(20))]
    docs = spark.createDataFrame([(i, t, 5, "psm", "x", 3, "y") for i, t in rows], SCHEMA).repartition(3)
    made = infill.transform(docs)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(((i, *cut(i, t)) for i, t in rows), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    size = lambda x: None if x is None else len(x)
    want = sorted(((i, n, form, size(p), size(m), sha(out), sha(t or "")) for i, t in rows for n, form, p, m, _, out in [cut(i, t)]), key=repr)
    assert sorted(map(tuple, infill.digests(made).collect()), key=repr) == want
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"} and infill.transform(docs.limit(0)).count() == 0


def test_all_cuts_restore(spark):
    docs = spark.createDataFrame([(i, f"a<b c> <S <P <M {i}\x01 \x02") for i in range(300)], "doc_id long, text string")
    made = infill.transform(docs, rate=100, spm_rate=50).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    assert made.join(docs, "doc_id").filter("back = text").count() == 300 and made.filter("form = 'plain'").count() == 0


def test_markers_are_injected_once(spark):
    """The text is matched against the units' pattern once, however many parts are cut from it, and nothing leaves the JVM."""
    plan = infill.digests(infill.transform(spark.range(3).selectExpr("id AS doc_id", "concat('a b ', id) AS text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
