from helpers import folded
from pyspark.sql import functions as F

from failsig.functions.replies import parse_reply
from failsig.operators import categorize

GOOD = '{"category": "test-race", "confidence": "high"}'
CASES = {
    GOOD: ("test-race", "high", "", ""),
    "text\n```json\n" + GOOD + "\n```\nmore {x}": ("test-race", "high", "", ""),
    "```\nno object\n```\n``` " + GOOD + "```": ("test-race", "high", "", ""),
    "Sure: " + GOOD + " done": ("test-race", "high", "", ""),
    '{"category": " infrastructure ", "confidence": "medium-to-very-high"}': ("infrastructure", "medium-to-very-h", "", ""),
    '{"category": "gremlins", "analysis": " x "}': ("", "", "x", ""),
    '{"category": "test-race", "mitigation": "' + "m" * 900 + '"}': ("test-race", "", "", "m" * 800),
    '{"category": null}': ("", "", "", ""),
    "{}": ("", "", "", ""),
    '{"category": "test-race", ': None,
    GOOD + " " + GOOD: None,
    GOOD + ", " + GOOD: None,
    "{'category': 'test-race'}": None,
    "} nothing {": None,
    "": None,
}


def test_replies(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "content string")
    rows = df.select("content", parse_reply(F.col("content")).alias("r")).collect()
    assert {r.content: r.r and tuple(r.r) for r in rows} == CASES
    assert df.limit(1).select(parse_reply(F.lit(None).cast("string")).alias("r")).first().r is None


def test_prompt(spark):
    p = folded(spark, {"run_id": 1}, {"run_id": 2, "distro": "debian"}, {"test_name": "done"})
    given = F.when(F.col("title") == "done", "infrastructure").otherwise("")
    p = p.with_core(p.core.withColumn("category", given))
    (row,) = categorize.prompts(p).collect()
    assert "Test: volume list shows labels\nOccurrences: 2\n" in row.prompt
    # axes by name, as stored documents have them
    assert "distro=debian/fedora-prior, mode=local, priv=root, suite=sys" in row.prompt
    assert "not captured" in row.prompt and "- deterministic-regression" in row.prompt
    assert categorize.prompts(p, force=True).count() == 2


def test_a_failing_callback_costs_nothing(spark):
    p = folded(spark, {"test_name": "good"}, {"test_name": "bad"}, {"test_name": "odd"})

    def answer(prompt):
        if "Test: bad" in prompt:
            raise OSError("unreachable")
        return GOOD if "Test: good" in prompt else "no idea"

    replies = categorize.ask(categorize.prompts(p), answer)
    core = categorize.apply_replies(p.core, categorize.usable_replies(replies))
    assert {r.title: (r.category, r.confidence) for r in core.collect()} == {
        "good": ("test-race", "high"),
        "bad": ("", ""),
        "odd": ("", ""),
    }
    assert core.columns == p.core.columns
