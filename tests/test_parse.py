from pyspark.sql import functions as F

from failsig.functions.dimensions import artifact_axes, dim_label, is_log_artifact
from failsig.functions.html import decode_entities, strip_tags
from failsig.operators.parse import parse_logs, repo_relative

GINKGO = """<div>&larr; Exit [AfterEach]
</div>
<span class="t">[+0350s] </span><span>• [FAILED] <b>[7.5 seconds]</b></span>
<span class="t">         </span><h2>Suite one</h2>
<span class="t">         </span>/var/tmp/org/podman/test/e2e/store_test.go:22
<span class="t">         </span><h2>  [It] builds with a secret</h2>
<span class="t">         </span>  /var/tmp/org/podman/test/e2e/store_test.go:92
<span title="--opt
--other">[options]</span>
<div class='log-error'>
<span class="t">         </span>  [FAILED] exit status 77 &amp;
<span class="t">         </span>  more of the message
<span class="t">         </span>  In [It] at: /var/tmp/org/podman/test/e2e/store_test.go:116 @ 03/02/25 11:09:08.125
* [FAILED] [1.0 seconds]
Suite two
  /ci/test/e2e/run_test.go:5
  [It] panics
  /ci/test/e2e/run_test.go:7

   panic: boom
   goroutine 1
"""
BATS = """<span> </span>ok 92 |035| passes in 9251ms
<span> </span><a name='x'>not ok 93 |035| follows the journal in 5120ms</a>
<span> </span># tags: ci:parallel
<span> </span>#  in test file test/system/<a href="x">044-journal.bats</a>, line 71)
<span> </span>#   `wait_until journald&#39; failed with 3
&lt;+622ms&gt; # not a diagnostic
ok 94 |035| passes
not ok 95 |040| no cause
# one
  # two
not ok 96 plain name
ok 97 |1| x in 1ms
"""
CLEAN = "<html>all passed</html>"


def parse(spark, *logs):
    df = spark.createDataFrame(list(logs), "id int, suite string, html string")
    return parse_logs(df).orderBy("id", "parser_ord", "pos").collect()


def test_artifact_names(spark):
    cases = {
        "int-remote-root-fedora-prior.logs": ("int", "remote", "root", "fedora-prior"),
        "sys-local-rootless-debian-sid.logs": ("sys", "local", "rootless", "debian-sid"),
        "build---fedora-current.logs": ("build", "", "", "fedora-current"),
        "unit--root-fedora-current.logs": ("unit", "", "root", "fedora-current"),
        "windows-installer-wsl-diag": ("windows-installer-wsl-diag", "", "", ""),
        "apiv2--rootless-fedora-current.logs": ("apiv2--rootless-fedora-current", "", "", ""),
        "int-local-root-x.logs.logs": ("int", "local", "root", "x"),
    }
    df = spark.createDataFrame([(n,) for n in cases], "name string")
    df = df.select("name", *[c.alias(a) for a, c in artifact_axes(F.col("name")).items()])
    rows = df.withColumn("label", dim_label()).collect()
    assert {r.name: tuple(r[1:5]) for r in rows} == cases
    assert {r.name: r.label for r in rows}["build---fedora-current.logs"] == "build-fedora-current"
    assert df.filter(is_log_artifact(F.col("name"))).count() == len(cases) - 1


def test_html(spark):
    cases = {
        "<span class='x'>a &amp; b</span>": "a & b",
        "<b\nclass='x'>c</b> 1 < 2": "c 1 < 2",
        "&amp;lt; &#39;q&#39; &quot;": "&lt; 'q' \"",
        "&eacute;&#x41;&#66 &amp &notit; & &;": "éAB & ¬it; & &;",
        "plain": "plain",
    }
    df = spark.createDataFrame([(n,) for n in cases], "raw string")
    df = df.withColumn("s", strip_tags(F.col("raw"))).withColumn("t", decode_entities(F.col("s")))
    assert {r.raw: r.t for r in df.collect()} == cases


def test_repo_relative(spark):
    cases = {
        "/var/tmp/x/podman/test/e2e/a.go:1": "test/e2e/a.go:1",
        "/a/pkg/b/test/c": "test/c",
        "/a/cmd/b/libpod/c": "libpod/c",
        "/a/pkg/x": "pkg/x",
        "test/system/a.bats": "test/system/a.bats",
        "": "",
    }
    df = spark.createDataFrame([(n,) for n in cases], "p string")
    assert {r.p: r.r for r in df.select("p", repo_relative(F.col("p")).alias("r")).collect()} == cases


def test_first_grammar(spark):
    one, two = parse(spark, (1, "int", GINKGO))
    assert (one.test_name, one.suite_name) == ("builds with a secret", "Suite one")
    assert one.test_file == "test/e2e/store_test.go:116"
    assert one.error_excerpt == "exit status 77 &\n           more of the message"
    assert (two.test_name, two.test_file) == ("panics", "test/e2e/run_test.go:7")
    assert two.error_excerpt == "panic: boom\ngoroutine 1"


def test_second_grammar(spark):
    one, two, three = parse(spark, (1, "sys", BATS))
    assert (one.test_name, one.suite_name) == ("follows the journal", "035")
    assert one.test_file == "test/system/044-journal.bats:71"
    assert one.error_excerpt == "`wait_until journald' failed with 3"
    assert (two.test_name, two.test_file, two.error_excerpt) == ("no cause", "040", "one\ntwo")
    assert (three.test_name, three.suite_name, three.test_file) == ("plain name", "", "")
    assert three.error_excerpt == ""


def test_suite_picks_the_grammar(spark):
    both = GINKGO + BATS
    rows = parse(spark, (1, "int", both), (2, "sys", both), (3, "unit", both), (4, "int", CLEAN))
    assert [(r.id, r.parser_ord) for r in rows] == [
        (1, 0), (1, 0), (2, 1), (2, 1), (2, 1), (3, 0), (3, 0), (3, 1), (3, 1), (3, 1),
    ]


def test_excerpts_are_cut(spark):
    long = "* [FAILED] [1]\nS\n /x/test/e2e/a.go:1\n [It] t\n /x/test/e2e/a.go:2\n"
    fallback, message = parse(
        spark,
        (1, "int", long + "y" * 5000),
        (2, "int", long + "[FAILED] " + "z" * 5000 + "\n In [It] at: /x/test/e2e/a.go:3"),
    )
    assert fallback.error_excerpt == "y" * 600
    assert message.error_excerpt == "z" * 2000


def test_twelve_diagnostics(spark):
    text = "not ok 1 t\n" + "".join(f"# line {i}\n" for i in range(30))
    (row,) = parse(spark, (1, "sys", text))
    assert row.error_excerpt.split("\n") == [f"line {i}" for i in range(12)]


def test_result_line_without_a_name(spark):
    """White space before a name may hold a line break, so the next line is the name."""
    one, two = parse(spark, (1, "sys", "not ok 5\n# a\nok 6 x\nnot ok 8\nok 9 b\n# z\nok 10 q"))
    assert (one.test_name, one.error_excerpt) == ("# a", "")
    assert (two.test_name, two.error_excerpt) == ("ok 9 b", "z")
