"""The cascade against a plain reading of the rules, in any order, and its edge cases."""

import itertools
import random
import re

import duckdb

from trainframe.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "word " * 60,
    "one two three four five six seven eight nine ten " * 3 + " ".join(f"w{k}" for k in range(60)),
    "\n".join(["same line here", "another line"] * 20 + [f"line number {k} of many" for k in range(20)]),
    " ".join(f"UPPER{k}CASE" for k in range(80)),
    " ".join(f"word{k}#$%" for k in range(80)),
    " ".join(f"a{k}!" for k in range(80)),
    " ".join(f"plain{k} words with spaces" for k in range(60)),
    " ".join(chr(97 + k % 26) for k in range(300)),
    "x" * 200_000,
    " ".join(f"l{'o' * 30}ng{k}" for k in range(60)),
    " ".join(f"mot{k} é ü 漢字" for k in range(50)),
]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, rep = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    failed = n < 50 or 100 * rep > 50 * n
    upper, bangs = len(re.findall("[A-Z]", text)), text.count("!")
    bad = chars < 2 * n or chars > 20 * n or 10 * symbols > n or 10 * dup > 3 * len(lines) or 10 * rep > 3 * n or 2 * upper > chars or 2 * bangs > n
    return (n, chars, symbols, dup, rep, failed, not failed and not bad)


def frame(spark):
    rows = [(k, t, -1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0), (None, TEXTS[5], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long").repartition(2)


def test_equals_brute_force_in_any_order(spark):
    want = sorted([(k if k is not None else -1, *brute(t)) for k, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[5])]])
    for order in (None, [0, 1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0]):
        got = q.cascade(frame(spark), order=order).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in got) == want
    assert {x[-1] for x in want} == {True, False}


def test_long_texts_by_numbered_words(monkeypatch):
    """Texts beyond ``LONG`` bytes have the same statistics, cut wherever."""
    r = random.Random(3)
    texts = [t for t in TEXTS if t] + [" ".join(r.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 50, 3000)] + [" ".join(f"w{r.randint(0, 300)}" for _ in range(5000))]
    for long in (1, 7, 1000):
        monkeypatch.setattr(q, "LONG", long)
        for t in texts:
            x = q.Features(t.encode())
            assert (x.n_words, x.n_repeat_words) == (brute(t)[0], brute(t)[4])


def test_each_rule_rejects_what_it_names():
    hit = {r.name: {k for k, t in enumerate(TEXTS) if r.rejects(q.Features(t.encode() if t else None))} for r in q.RULES}
    assert all(hit.values())


def test_order_is_by_rejections_per_second(spark):
    measured = q.order_rules(frame(spark))
    assert sorted(m[0] for m in measured) == list(range(len(q.RULES)))
    gain = [m[1] / max(m[2], 1e-9) for m in measured]
    assert all(a >= b for a, b in itertools.pairwise(gain))


def test_order_counts_what_passes_the_base(spark):
    """Rejections and seconds are those of documents that rules see: none of those that the base fails."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return False

    q.order_rules(frame(spark), (q.Rule("count", count),))
    assert seen.value == sum(not brute(t)[5] for t in [*TEXTS, TEXTS[3], TEXTS[5]])


def test_short_circuit(spark):
    """After the first rule that rejects a document no other sees it."""
    calls = spark.sparkContext.accumulator(0)

    def second(x):
        calls.add(1)
        return False

    rules = (q.Rule("all", lambda x: True), q.Rule("none", second))
    q.cascade(frame(spark), rules, [0, 1]).collect()
    assert calls.value == 0


def test_empty_table_and_sql(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.cascade(empty).count() == 0
    frame(spark).drop("n_words").write.parquet(str(tmp_path / "documents.parquet"))
    got = q.op4_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(q.OP4_SQL).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
