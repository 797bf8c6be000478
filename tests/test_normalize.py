import random
import re
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from failsig.functions.normalize import RULES, normalize, signature_hash, with_fingerprint
from failsig.functions.text import WHITESPACE, lines_after, pack_lines, split_lines, strip

GOLDEN = {
    "4f7bbf3deb36f4a2": "podman build with a secret from file|Command failed with exit status <N>."
    " See above for error message.",
    "03cae67e227ff33c": "[<N>-containersEvents] GET events?stream=true: expected curl to time out;"
    " it did not|expected: actual:",
    "926566d90d191a6f": "[<N>-containersWait] Received headers from /wait|expected: ~ .*HTTP.* <N>"
    " OK.* actual: HTTP/<N>.<N> <N> Internal Server Error",
}

CASES = [
    ("at 03/02/25 11:09:08.125 it broke", "at <TIME> it broke"),
    ("since 2025-03-02T11:09:08Z", "since <TIME>"),
    ("since 2025-03-02 11:09:08.5", "since <TIME>"),
    ("[12:19:41] boom", "<TIME> boom"),
    ("took 5120ms, or 9.6 seconds", "took <DUR>, or <DUR>"),
    ("<+622ms> x <+5> y", "<+<DUR>> x <DUR> y"),
    ("f(0xc000aa1100) +0x2f", "f(<ADDR>) +<ADDR>"),
    ("id " + "ab12cd34" * 8, "id <SHA256>"),
    ("id ab12cd34ef56", "id <ID>"),
    ("/tmp/CI_aBcD/podman_bats.xYz123/f", "/tmp/CI_<RAND>/podman_bats.<RAND>/f"),
    ("/var/tmp/some-org/podman/test/e2e/x.go", "test/e2e/x.go"),
    ("/home/me/x", "/<HOME>/x"),
    ("c-vol-t7-k3v9q2zz", "c-vol-t7-<RAND>"),
    ("podman-remote", "podman-<RAND>"),
    ("bind 0.0.0.0:40123 in use", "bind <N>.<N>.<N>.<N>:<PORT> in use"),
    ("PID 12 and pid=7", "pid=<PID> and pid=<PID>"),
    ("exit status 77, t93", "exit status <N>, t93"),
    ("  a \t\n b\u2003c\x1c ", "a b c"),
    ("", ""),
]


def python_normalize(text):
    def step(t, rule):
        pattern, replacement, ignore_case = rule
        return re.sub(pattern, replacement, t, flags=re.IGNORECASE if ignore_case else 0)

    return reduce(step, RULES, text.strip()).strip()


def test_cases(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, a string")
    got = {r.i: r.n for r in df.select("i", normalize(F.col("a")).alias("n")).collect()}
    assert [got[i] for i in range(len(CASES))] == [b for _, b in CASES]


def test_agrees_with_python_regular_expressions(spark):
    """Unicode digits, letters, marks and spaces, where the dialects differ by default."""
    rng = random.Random(7)
    pieces = [
        "12", "0x1f", "é", "e\u0301", "٠١", "²", "Ⅷ", "_", "-", " ", "\xa0", "\x1d", "\x85",
        "\u2028", "\n", "ms", "s", "seconds", "pid=", "PİD ", "pıd=", ":", "4318", "/home/", "/tmp/CI_", "ab", "deadbeef",
        "abcdef012345", "<+", ">", "podman_bats.", "/var/tmp/", "/podman/", "[12:00:00]", "中", "\U0001d7dc", ".", "Z",
        "2025-03-02T11:09:08", "08/15/26 20:38:15", "K", "xyz123-", "\u200d",
    ]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    got = {r.i: r.n for r in df.select("i", normalize(F.col("a")).alias("n")).collect()}
    wrong = [(t, got[i], python_normalize(t)) for i, t in enumerate(texts) if got[i] != python_normalize(t)]
    assert not wrong, wrong[:3]


def test_ascii_texts_take_the_cheap_way_to_the_same_result(spark):
    """ASCII texts are replaced by batches, all others and nulls by the native chain."""
    rng = random.Random(8)
    pieces = [
        "12", "0x1f", "0xZ", "a", "f", "_", "-", " ", "  ", "\t", "\x0b", "\x1c", "\x1f", "\r\n", "\x00", "\x7f",
        "ms", "s", "sec", "seconds", "pid=", "PID ", "pId ", ":", "4318", "/home/", "/tmp/CI_", "deadbeef", "abcdef012345",
        "ab12cd34" * 8, "<+", ">", "<", "podman_bats.", "/var/tmp/", "/podman/", "[12:00:00]", ".", "Z", "T", "$1", "\\1",
        "2025-03-02T11:09:08", "2025-03-02 ", "08/15/26 20:38:15", "08/15/26", "xyz123-", "A-", "k3v9q2zz", "'`",
    ]
    ascii_only = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(6000)]
    texts = [*ascii_only, None, "caf\u00e9 12ms", " \u2003 7 "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    out = df.select("i", normalize(F.col("a")).alias("n"))
    got = {r.i: r.n for r in out.collect()}
    expected = [t if t is None else python_normalize(t) for t in texts]
    assert not (wrong := [(t, got[i], e) for i, (t, e) in enumerate(zip(texts, expected)) if got[i] != e]), wrong[:3]
    assert "ArrowEvalPython [clean(CASE WHEN" in out._jdf.queryExecution().executedPlan().toString()


def test_strip_and_split_lines_follow_python(spark):
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    texts = [f"a{sep}b" for sep in ("\r\n", *map(chr, range(0x2030)))] + [" x ", "\u3000x\x1f", "\n\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    rows = df.select("i", strip(F.col("a")).alias("s"), split_lines(F.col("a")).alias("l")).collect()
    for r in rows:
        assert r.s == texts[r.i].strip()
        # str.splitlines has no element behind a final break
        lines = r.l[:-1] if r.l[-1] == "" else r.l
        assert lines == texts[r.i].splitlines(), repr(texts[r.i])


def test_line_helpers_equal_splitting(spark):
    rng = random.Random(3)
    pieces = ["a", "# b", "#", " ", "\t", "\xa0", "\r\n", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\u2028"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select(
        "i", pack_lines(F.col("t")).alias("p"), lines_after(F.col("t"), "#").alias("m")
    ).collect()
    for r in rows:
        lines = [line.strip() for line in texts[r.i].splitlines()]
        assert r.p == "\n".join(line for line in lines if line), repr(texts[r.i])
        marked = [line[1:].strip() for line in lines if line.startswith("#")]
        assert [m.strip() for m in r.m] == marked, repr(texts[r.i])


@pytest.mark.parametrize("expected", GOLDEN)
def test_golden_hashes(spark, expected):
    row = spark.createDataFrame([(GOLDEN[expected],)], "s string")
    assert row.select(signature_hash(F.col("s"))).first()[0] == expected


def hashes(spark, *records):
    df = with_fingerprint(spark.createDataFrame(list(records), "test_name string, error_excerpt string"))
    return [r.signature_hash for r in df.collect()]


def test_one_flake_in_two_runs_has_one_hash(spark):
    a, b = hashes(
        spark,
        ("podman logs", "`f journald' failed at 03/02/25 11:09:08.125 in 5120ms for c-t7-k3v9q2zz"),
        ("podman logs", "`f journald' failed at 03/04/25 06:15:59.5 in 977ms for c-t7-m8w4r1yy"),
    )
    assert a == b and len(a) == 16


def test_test_and_error_both_count(spark):
    a, b, c = hashes(spark, ("build", "exit 125"), ("run", "exit 125"), ("build", "timed out"))
    assert len({a, b, c}) == 3


def test_hash_shares_the_regex_chain(spark):
    df = with_fingerprint(spark.createDataFrame([("a", "b")], "test_name string, error_excerpt string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<SHA256>") == 2  # once for the name, once for the error


def test_lines_cost_about_what_plain_ones_do(spark):
    """Whatever ends a line in Python, a text is read at about the price of line feeds alone."""
    rng = random.Random(9)
    pieces = ["#", " ", "  ", "\t", "\xa0", " ", "\x1f", "　", "a", "é", "\U0001d7dc", "\n", "\r\n", "\x0b", "\x1d", "\x85", " "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 16))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", pack_lines(F.col("t")).alias("p"), lines_after(F.col("t"), "#").alias("m")).collect()
    for r in rows:
        lines = texts[r.i].splitlines()
        assert r.p == "\n".join(x.strip() for x in lines if x.strip()), repr(texts[r.i])
        assert r.m == [x.lstrip()[1:] for x in lines if x.lstrip().startswith("#")], repr(texts[r.i])

    long = spark.range(40_000).select(F.repeat(F.concat("id", F.lit(" # some words of a line\n#  and of another ")), 20).alias("t"))

    def seconds(c):
        began = time.perf_counter()
        long.select(c).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    plain = F.regexp_extract_all("t", F.lit(r"(?dm)^[ \t]*+#([^\n]*+)"), F.lit(1))
    ways = {"plain": plain, "lines": lines_after(F.col("t"), "#")}
    took = {name: min(seconds(c) for _ in range(4)) for name, c in ways.items()}
    assert took["lines"] < 4 * took["plain"], took
