"""Queries over small inline texts, one for each format.

The texts are written here for the formats' published shapes; the SQL lists the rows that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import filters, rules, web
from ..operators.formats import engine, special, vcs
from ..operators.formats.catalog import BY_NAME, FORMATS

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def values(columns: str, *rows: tuple) -> str:
    """SQL for these rows."""
    def lit(x) -> str:
        return "null" if x is None else str(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


def text(spark: SparkSession, *texts: str) -> DataFrame:
    """(source_id, line_no, line) of inline texts."""
    rows = [(i, n + 1, x) for i, t in enumerate(texts) for n, x in enumerate(t.strip("\n").split("\n"))]
    return spark.createDataFrame(rows, "source_id bigint, line_no bigint, line string")


def whole(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "source_id bigint, text string")


def summary(name: str, fixture: str, columns: str, *rows: tuple) -> None:
    """A query that counts a format's records by its keys."""
    fmt = BY_NAME[name]
    names = columns.split(",")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = engine.summarize(engine.parse(text(spark, fixture), fmt), fmt)
        return s.select(*[c.strip() for c in names])

    QUERIES[f"fmt_{name}"] = (run, values(columns, *rows))


summary("db_log", """
2026-01-01 00:00:00.123 UTC [99] LOG:  duration: 150.2 ms  statement: SELECT 1
2026-01-01 00:00:01.123 UTC [99] ERROR:  relation "t" does not exist
2026-01-01T00:00:00.000001Z 12 [Warning] aborted connection
{"s":"I","c":"COMMAND","ctx":"conn1","msg":"Slow query"}
7:M 01 Jan 2026 00:00:00.000 # Out of memory
""", "kind,level,n,total", ("pg_duration", "LOG", 1, 150.2), ("pg", "ERROR", 1, 0.0), ("mysql", "Warning", 1, 0.0), ("mongo", "", 1, 0.0), ("redis", "#", 1, 0.0))
summary("syslog", """
Jan  1 00:00:00 host1 sshd[42]: session opened
Jan  1 00:00:01 host1 sshd[43]: session closed
Jan  1 00:00:02 host2 cron: started
""", "kind,file,key,n", ("entry", "host1", "sshd", 2), ("entry", "host2", "cron", 1))
summary("maven", """
[WARNING] /a/B.java:[3,5] deprecated
[ERROR] /a/C.java:[7,1] cannot find symbol
[INFO] Tests run: 5, Failures: 1, Errors: 0, Skipped: 2
Downloading from central: https://repo.example/x.jar
[INFO] BUILD FAILURE
""", "kind,level,n", ("javac", "WARNING", 1), ("javac", "ERROR", 1), ("tests", "", 1), ("download", "", 1), ("result", "FAILURE", 1))
summary("gcc_log", """
src/a.c:10:2: warning: unused variable 'x' [-Wunused-variable]
src/a.c:12:2: warning: unused variable 'y' [-Wunused-variable]
src/b.c:1:1: error: expected ';'
/tmp/x.o:(.text+0x5): undefined reference to `foo'
[3/9] Building C object x.o
make[2]: Leaving directory
""", "kind,level,key,n", ("diagnostic", "warning", "-Wunused-variable", 2), ("diagnostic", "error", "", 1), ("linker", "error", "foo", 1), ("ninja", "", "", 1), ("make", "", "2", 1))
summary("terraform", """
  # aws_s3_bucket.a will be created
  # aws_s3_bucket.b will be destroyed
      id = (known after apply)
Plan: 1 to add, 0 to change, 1 to destroy
""", "kind,level,n", ("resource", "created", 1), ("resource", "destroyed", 1), ("unknown", "", 1), ("plan", "", 1))
summary("cloudformation", """
CREATE_IN_PROGRESS Stack
CREATE_FAILED Bucket AccessDenied
CREATE_FAILED Queue Denied
""", "kind,level,n", ("event", "CREATE_IN_PROGRESS", 1), ("event", "CREATE_FAILED", 2))
summary("ansible", """
TASK [install]
ok: [web1]
changed: [web2]
TASK [restart]
ok: [web1]
web1 : ok=2 changed=0
""", "context,kind,level,n", ("install", "host", "ok", 1), ("install", "host", "changed", 1), ("restart", "host", "ok", 1), ("restart", "recap", "", 1))
summary("pytest", """
collected 4 items
t/test_a.py::test_b FAILED
t/test_a.py::test_c PASSED
[gw0] [ 50%] PASSED t/test_a.py::test_d
===== 1 failed, 2 passed in 0.1s =====
""", "kind,level,n,total", ("collected", "", 1, 4.0), ("test", "FAILED", 1, 0.0), ("test", "PASSED", 2, 0.0), ("summary", "", 1, 0.0))
summary("protobuf", """
a.proto:3:1: error: Expected ";".
a.proto:9: warning: Import unused.
""", "kind,level,n", ("diagnostic", "error", 1), ("diagnostic", "warning", 1))
summary("pulumi", """
 +  aws:s3/bucket:Bucket  data
 ~  aws:sqs/queue:Queue  q
Resources: 1 to create
""", "kind,level,n", ("resource", "+", 1), ("resource", "~", 1), ("summary", "", 1))
summary("helm", """
NAME: web
STATUS: deployed
deployment/web created
""", "kind,key,level,n", ("field", "NAME", "", 1), ("field", "STATUS", "", 1), ("resource", "deployment/web", "", 1))
summary("bazel", """
INFO: Analyzed 3 targets
//a:b PASSED in 0.1s
//a:c FAILED in 0.2s
""", "kind,key,level,n", ("info", "Analyzed", "", 1), ("target", "//a:b", "PASSED", 1), ("target", "//a:c", "FAILED", 1))
summary("node_error", """
TypeError: x is not a function
    at run (a.js:1:2)
""", "kind,key,level,n", ("error", "TypeError", "error", 1), ("frame", "run", "", 1))
summary("dotnet", """
Prog.cs(3,5): error CS1002: ; expected
   at App.Main(String[] args) in Prog.cs:line 9
""", "kind,key,level,n", ("error", "CS1002", "error", 1), ("frame", "App.Main", "", 1))
summary("php_ruby", """
PHP Fatal error:  Uncaught Error in /a.php on line 3
#0 /b.php(9): f()
""", "kind,key,level,n", ("php", "", "Fatal error", 1), ("frame", "", "", 1))
summary("rust_go", """
   Compiling a v0.1
   Compiling b v0.1
error[E0382]: use of moved value
test t::one ... ok
test t::two ... FAILED
--- FAIL: TestX (0.40s)
""", "kind,level,n,total", ("compiling", "", 2, 0.0), ("code", "error", 1, 0.0), ("cargo_test", "ok", 1, 0.0), ("cargo_test", "FAILED", 1, 0.0), ("go_test", "FAIL", 1, 0.4))
summary("android_gradle", """
> Task :app:a UP-TO-DATE
> Task :app:b
> Task :app:c UP-TO-DATE
warn: removing resource com.x:string/a without default value.
JAVA_HOME=/j
""", "kind,level,n", ("task", "UP-TO-DATE", 2), ("task", "", 1), ("resource", "", 1), ("env", "", 1))
summary("xcode_log", """
cd /src
clang -x c /dev/null
CompileC a.o (in target 'App' from project 'P')
""", "kind,key,n", ("cd", "", 1), ("probe", "", 1), ("task", "CompileC", 1))
summary("unity_unreal", """
Loading asset A
Unloading B
x 0123456789ABCDEF0123456789ABCDEF
""", "kind,n", ("asset", 2), ("guid", 1))
summary("spring_boot", """
2026-01-01 00:00:00 INFO 7 --- [main] a.b.App : Started
2026-01-01 00:00:01 WARN 7 --- [main] a.b.App : Slow
""", "kind,level,n", ("log", "INFO", 1), ("log", "WARN", 1))
summary("nodejs", """
npm WARN deprecated a@1: old
added 10 packages in 2s
3 vulnerabilities
a.ts(1,2): error TS2304: Cannot find name
  1:5  error  Unexpected var  no-var
Tests:       1 failed, 2 passed, 3 total
""", "kind,level,key,n,total", ("deprecated", "", "a@1", 1, 0.0), ("added", "", "", 1, 10.0), ("vulnerable", "", "", 1, 3.0), ("tsc", "error", "TS2304", 1, 0.0), ("eslint", "error", "no-var", 1, 0.0), ("jest", "", "Tests", 1, 0.0))
summary("webpack_vite", """
asset main.js 10.5 KiB
ERROR in Module not found: x
WARNING in big asset
""", "kind,level,n,total", ("asset", "KiB", 1, 10.5), ("error", "error", 1, 0.0), ("warning", "warning", 1, 0.0))
summary("kubernetes_docker", """
prod/api-7d9f8c6b5d-abcde started
container 0123456789abcdef
""", "kind,key,level,n", ("pod", "prod", "", 1), ("container", "0123456789abcdef", "", 1))
summary("cloud_log", """
{"timestamp":"2026-01-01T00:00:00Z","severity":"ERROR","textPayload":"disk full"}
2026-01-01T00:00:00Z INFO api started
[INFO] 2026-01-01T00:00:00Z ab-12 ok
""", "kind,level,n", ("json", "ERROR", 1), ("text", "INFO", 1), ("lambda", "INFO", 1))
summary("shell_session", """
me@host:~$ ls -la
HOME=/root
""", "kind,key,n", ("command", "", 1), ("env", "HOME", 1))
summary("git_diff", """
diff --git a/x.c b/x.c
@@ -1,2 +1,2 @@
-a
+b
+c
""", "context,kind,n", ("x.c", "file", 1), ("x.c", "hunk", 1), ("x.c", "del", 1), ("x.c", "add", 2))

_JAVA = """
Exception in thread "main" java.lang.IllegalStateException: no
\tat a.B.c(B.java:3)
\tat a.B.d(B.java:4)
Exception in thread "main" java.lang.IllegalStateException: no
\tat a.B.c(B.java:3)
\tat a.B.d(B.java:4)
Exception in thread "x" java.io.IOException: gone
\tat a.B.c(B.java:3)
"""


@query("fmt_java_stack", values("block,line_start,n_frames,copy", (1, 1, 2, 1), (2, 4, 2, 2), (3, 7, 1, 1)))
def _java(spark, sf):
    return special.stacks(text(spark, _JAVA), r"^Exception in thread", r"^\s*at ").select("block", "line_start", "n_frames", "copy")


@query("fmt_java_exceptions", values("key,n", ("java.lang.IllegalStateException", 2)))
def _java_counts(spark, sf):
    return special.exception_counts(engine.parse(text(spark, _JAVA), BY_NAME["java_stack"]).where("kind = 'head'"))


@query("fmt_java_truncated", values("line_no", (1,), (2,), (4,), (5,), (7,), (8,)))
def _java_cut(spark, sf):
    return special.truncate_frames(text(spark, _JAVA), r"^Exception in thread", r"^\s*at ", 1).select("line_no")


_PY = """
Traceback (most recent call last):
  File "a.py", line 3, in f
ValueError: bad
Traceback (most recent call last):
  File "b.py", line 4, in g
ValueError: worse
"""


@query("fmt_python_traceback", values("key,n", ("ValueError", 2)))
def _python(spark, sf):
    return special.exception_counts(engine.parse(text(spark, _PY), BY_NAME["python_traceback"]).where("kind = 'exception'"))


@query("fmt_go_test", values("package,passed,failed,skipped,slow,failed_tests", ("p/a", 1, 1, 0, 1, "TestX"), ("p/b", 1, 0, 1, 0, ""), (None, 2, 1, 1, 1, "TestX")))
def _go(spark, sf):
    rows = [("run", "p/a", "TestX", None), ("fail", "p/a", "TestX", 0.4), ("pass", "p/a", "TestY", 2.0), ("pass", "p/b", "TestZ", 0.1), ("skip", "p/b", "TestS", 0.0), ("pass", "p/b", None, 3.0)]
    import json

    lines = "\n".join(json.dumps({k: v for k, v in zip(("Action", "Package", "Test", "Elapsed"), r, strict=True) if v is not None}) for r in rows)
    return special.go_test(text(spark, lines)).drop("source_id")


_CI = """
::group::build
compile a
warning: slow
::endgroup::
::group::test
::error::unit tests failed
Retrying once
cache restored
::endgroup::
"""


@query("fmt_ci", values("steps,errors,warnings,artifacts,caches,retries,status", (2, 1, 1, 0, 1, 1, "failed")))
def _ci(spark, sf):
    return special.ci_summary(text(spark, _CI), BY_NAME["ci_log"])[0].select("steps", "errors", "warnings", "artifacts", "caches", "retries", "status")


@query("fmt_ci_steps", values("step,lines,errors,warnings", ("build", 2, 0, 1), ("test", 3, 1, 0)))
def _ci_steps(spark, sf):
    return special.ci_summary(text(spark, _CI), BY_NAME["ci_log"])[1].drop("source_id")


@query("fmt_db_durations", values("n,avg_ms,max_ms,slow", (2, 125.1, 150.2, 2)))
def _durations(spark, sf):
    t = text(spark, "2026-01-01 00:00:00.123 UTC [99] LOG:  duration: 150.2 ms  statement: SELECT 1\n2026-01-01 00:00:00.123 UTC [99] LOG:  duration: 100.0 ms  statement: SELECT 2")
    return special.db_durations(t, BY_NAME["db_log"]).drop("stmt")


@query("fmt_gcc_fold", values("sig,shown,more", ("-Wx", 3, 2)))
def _fold(spark, sf):
    t = text(spark, "\n".join(f"a.c:{i}:1: warning: w {i} [-Wx]" for i in range(5)))
    return special.fold_warnings(t, BY_NAME["gcc_log"]).drop("source_id")


@query("fmt_maven_totals", values("run,failures,errors,skipped", (8, 1, 0, 2)))
def _maven(spark, sf):
    t = text(spark, "[INFO] Tests run: 5, Failures: 1, Errors: 0, Skipped: 2\n[INFO] Tests run: 3, Failures: 0, Errors: 0, Skipped: 0")
    return special.maven_totals(t, BY_NAME["maven"]).select("run", "failures", "errors", "skipped")


@query("fmt_terraform_totals", values("n_a,n_d,n_m,n_r,known_after_apply,plan_add,plan_change,plan_destroy", (1, 1, 0, 0, 1, 1, 0, 1)))
def _terraform(spark, sf):
    t = text(spark, "# a.b will be created\n# a.c will be destroyed\nx = (known after apply)\nPlan: 1 to add, 0 to change, 1 to destroy")
    return special.terraform_totals(t, BY_NAME["terraform"]).drop("source_id")


@query("fmt_ansible_tasks", values("task,status,hosts,n", ("install", "ok", "web1,web2", 2), ("install", "failed", "web3", 1)))
def _ansible(spark, sf):
    return special.ansible_tasks(text(spark, "TASK [install]\nok: [web2]\nok: [web1]\nfailed: [web3] => broken"), BY_NAME["ansible"]).drop("source_id")


@query("fmt_gradle_resources", values("package,n,text", ("com.x", 6, "[n0, ..., n5] (total 6)")))
def _gradle(spark, sf):
    t = text(spark, "\n".join(f"warn: removing resource com.x:string/n{i} without default value." for i in range(6)))
    return special.gradle_resources(t, BY_NAME["android_gradle"]).select("package", "n", "text")


@query("fmt_noise", values("line_no,line", (1, "start"), (2, "[6 noise lines]"), (8, "end"), (9, "Copying x")))
def _noise(spark, sf):
    return special.noise(text(spark, "start\n" + "\n".join(f"Copying {i}" for i in range(6)) + "\nend\nCopying x")).drop("source_id")


@query("fmt_javadoc", values("line_no,line", (1, "[javadoc: 4 pages]"), (5, "x")))
def _javadoc(spark, sf):
    return special.javadoc(text(spark, "\n".join(f"[2026-1-1T00:00:00Z] Generating /d/{i}.html..." for i in range(4)) + "\nx")).drop("source_id")


@query("fmt_compiling", values("line_no,line", (1, "Compiling 3 crates"), (4, "Finished")))
def _compiling(spark, sf):
    return special.compiling(text(spark, "   Compiling a\n   Compiling b\n   Compiling c\nFinished")).drop("source_id")


@query("fmt_probes", values("line_no,line", (1, "$XC|PROBE|x1"), (2, "x"), (3, "$XC|PROBE|x2")))
def _probes(spark, sf):
    return special.probes(text(spark, "cc /dev/null\nx\ncc /dev/null\nld /dev/null")).drop("source_id")


@query("fmt_assets", values("line_no,line", (1, "[6 asset operations]"), (7, "done")))
def _assets(spark, sf):
    return special.assets(text(spark, "\n".join(f"Loading a{i}" for i in range(6)) + "\ndone")).drop("source_id")


@query("fmt_generic_text", values("line_no,line", (1, "a b"), (2, "c"), (3, ""), (5, "d")))
def _generic(spark, sf):
    return special.clean_text(text(spark, "\x1b[31ma\tb\x1b[0m  \nx\rc\n\n\nd")).drop("source_id")


@query("fmt_ansi", values("source_id,t", (0, "red\n[stripped: 9 ANSI bytes]"), (1, "plain")))
def _ansi(spark, sf):
    return whole(spark, "\x1b[31mred\x1b[0m", "plain").select("source_id", special.ansi_report(F.col("text")).alias("t"))


@query("fmt_junit", values("tests,failures,errors,skipped,failing", (5, 1, 0, 1, "b")))
def _junit(spark, sf):
    return special.junit(whole(spark, '<testsuites><testsuite name="s" tests="2" failures="1" errors="0" skipped="0"><testcase name="a"/><testcase name="b"><failure/></testcase></testsuite><testsuite name="t" tests="3" failures="0" errors="0" skipped="1"></testsuite></testsuites>')).drop("source_id")


@query("fmt_sarif", values("tool,level,rule,n", ("lint", "error", "R1", 2), ("lint", "warning", "R2", 1)))
def _sarif(spark, sf):
    return special.sarif(whole(spark, '{"runs":[{"tool":{"driver":{"name":"lint"}},"results":[{"ruleId":"R1","level":"error"},{"ruleId":"R1","level":"error"},{"ruleId":"R2"}]}]}')).drop("source_id")


@query("fmt_json", values("t", ('{"a":[1,2],"b":1}',)))
def _json(spark, sf):
    return whole(spark, '{"b": 1,  "a": [1, 2]}').select(special.minify_json(F.col("text")).alias("t"))


@query("fmt_yaml")
def _yaml(spark, sf):
    return whole(spark, "a:\n" + "".join(f"  - {i}\n" for i in range(12))).select(special.compact_yaml("text").alias("t"))


@query("fmt_smart_code", values("pos,value", (0, "calculateTotal"), (1, "customerOrders")))
def _code(spark, sf):
    return special.identifiers(text(spark, "def calculateTotal(customerOrders): continue")).select("pos", "value")


@query("fmt_diff_context", values("line_no,line", (1, "... 3 context lines ..."), (4, " d"), (5, "+e"), (6, " f"), (7, "... 1 context lines ...")))
def _context(spark, sf):
    return special.diff_context(text(spark, " a\n b\n c\n d\n+e\n f\n g"), 1).drop("source_id")


@query("fmt_container", values("source_id,t", (0, "hello"), (1, "plain")))
def _container(spark, sf):
    return whole(spark, '{"log":"hello","stream":"stdout"}', "plain").select("source_id", special.unwrap_container(F.col("text")).alias("t"))


@query("fmt_shell_clean", values("line", ("ls -la",), ("out",)))
def _shell(spark, sf):
    return special.shell_clean(text(spark, "me@host:~$ ls -la\nHOME=/root\nout\nExtracting x")).select("line")


@query("fmt_method_args", values("t", ("  at A.B(...)",)))
def _args(spark, sf):
    return whole(spark, "  at A.B(String x, Int32 y)").select(special.method_args(F.col("text")).alias("t"))


@query("fmt_web_parse", values("source,ip,method,path,status,bytes,duration_ms", ("combined", "10.1.2.3", "GET", "/api/items/4711?x=1", "200", "512", None), ("uvicorn", "10.1.2.3", "GET", "/ping", "200", "-", None), ("json", "10.0.0.1", "GET", "/a", "404", "-", 250)))
def _web(spark, sf):
    t = text(spark, '10.1.2.3 - - [01/Jan/2026:00:00:01 +0000] "GET /api/items/4711?x=1 HTTP/1.1" 200 512 "-" "curl/8.0"\nINFO:     10.1.2.3:5000 - "GET /ping HTTP/1.1" 200 OK\n{"status": 404, "ip": "10.0.0.1", "method": "GET", "path": "/a", "request_time": "0.25"}\nnoise')
    return web.parse(t).select("source", "ip", "method", "path", "status", "bytes", "duration_ms")


@query("fmt_w3c", values("ip,method,path,status,duration_ms", ("10.0.0.1", "GET", "/a", "200", 12)))
def _w3c(spark, sf):
    return web.parse_delimited(text(spark, "#Software: x\n#Fields: date time c-ip cs-method cs-uri-stem sc-status time-taken\n2026-01-01 00:00:00 10.0.0.1 GET /a 200 12")).select("ip", "method", "path", "status", "duration_ms")


@query("fmt_cloud_dedup", values("value,msg,n", ("2026-01-01T00:00:00Z", "disk full", 2), ("2026-01-01T00:00:01Z", "disk full", 1)))
def _cloud(spark, sf):
    t = text(spark, "2026-01-01T00:00:00Z ERROR api disk  full\n2026-01-01T00:00:00Z ERROR api Disk full\n2026-01-01T00:00:01Z ERROR api disk full")
    return special.cloud_dedup(engine.parse(t, BY_NAME["cloud_log"])).select("value", "msg", "n")


@query("fmt_git_status", values("section,status,path", ("branch", "", "main"), ("staged", "A", "new.c"), ("unstaged", "M", "a.c"), ("unstaged", "D", "b.c"), ("untracked", "?", "c.c")))
def _status(spark, sf):
    return vcs.git_status(text(spark, "On branch main\nChanges to be committed:\n\tnew file:   new.c\n\nChanges not staged for commit:\n\tmodified:   a.c\n\tdeleted:    b.c\n\nUntracked files:\n\tc.c")).select("section", "status", "path")


@query("fmt_git_short", values("section,status,path", ("short", "M", "a.c"), ("short", "A", "b.c"), ("short", "?", "c.c"), ("short", "UU", "d.c")))
def _short(spark, sf):
    return vcs.git_status(text(spark, " M a.c\nA  b.c\n?? c.c\nUU d.c")).select("section", "status", "path")


_H1, _H2 = "a" * 12 + "1" * 28, "a" * 12 + "2" * 28


@query("fmt_git_log", values("hash,author,date,subject,merge", (_H1[:13], "jo", "2026-01-01 10:00:00", "First thing", False), (_H2[:13], "al.b", "2026-01-02 11:30:00", "Second", True)))
def _log(spark, sf):
    return vcs.git_log(text(spark, f"commit {_H1}\nAuthor: Jo <jo@x.org>\nDate:   Thu Jan 1 10:00:00 2026 +0000\n\n    First thing\n\ncommit {_H2} (HEAD -> main)\nMerge: 1 2\nAuthor: Al <al.b@x.org>\nDate:   Fri Jan 2 11:30:00 2026 +0000\n\n    Second\n")).select("hash", "author", "date", "subject", "merge")


@query("fmt_git_patch", values("line_no,path,line", (1, "x.c", "DIFF://x.c"), (5, "x.c", "@@ -1 +1 @@"), (6, "x.c", "-a"), (7, "x.c", "<TRUNCATED>")))
def _patch(spark, sf):
    return vcs.git_diff(text(spark, "diff --git a/x.c b/x.c\nindex 1..2\n--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n-a\n+b\n+c"), 2).drop("source_id")


@query("fmt_git_stat", values("path,changes,plus,minus", ("a.c", 5, 3, 2)))
def _stat(spark, sf):
    return vcs.diff_stat(text(spark, " a.c | 5 +++--\n 1 file changed")).select("path", "changes", "plus", "minus")


@query("fmt_git_graph", values("rank,total,line", (1, 3, "abc one"), (2, 3, "def two")))
def _graph(spark, sf):
    return vcs.log_graph(text(spark, "* abc one\n|\\\n| * def two\n|/\n* fed three"), 2).drop("source_id")


@query("fmt_git_reflog", values("rank,total,line", (1, 2, "abcdef1 HEAD@{0}: commit: x")))
def _reflog(spark, sf):
    return vcs.reflog(text(spark, "abcdef1 HEAD@{0}: commit: x\nabcdef2 HEAD@{1}: commit: y"), 1).drop("source_id")


@query("fmt_hash_short", values("t", ("x " + "a" * 10 + " y",)))
def _hash(spark, sf):
    return whole(spark, "x " + "a" * 40 + " y").select(vcs.shorten_hashes(F.col("text")).alias("t"))


@query("fmt_svn_update", values("n,revision,text", (11, "42", "[UPDATE] r42: 11 files updated")))
def _svn(spark, sf):
    return vcs.svn_update(text(spark, "\n".join(f"U    f{i}.c" for i in range(11)) + "\nUpdated to revision 42.")).drop("source_id")


_VCS = {
    "hg": ("changeset:   3:0a1b2c\nuser:        Jo\nsummary:     Fix\nM a.c", [("commit", None, None, "0a1b2c"), ("author", None, None, "Jo"), ("subject", None, None, "Fix"), ("file", "M", "a.c", None)]),
    "p4": ("Change 7 on 2026/01/01 by jo\n//depot/a.c#3 - edit", [("commit", None, None, "7"), ("file", "edit", "//depot/a.c", "3")]),
    "cvs": ("RCS file: /r/a.c,v\nrevision 1.2\nM b.c", [("diff_file", None, "/r/a.c,v", None), ("commit", None, None, "1.2"), ("file", "M", "b.c", None)]),
    "bzr": ("revno: 5\ncommitter: Jo\nmodified:\n  a.c", [("commit", None, None, "5"), ("author", None, None, "Jo"), ("section", None, None, "modified"), ("file", None, "a.c", None)]),
    "fossil": ("checkout:     0123456789abcdef\nEDITED     a.c", [("commit", None, None, "0123456789abcdef"), ("file", "EDITED", "a.c", None)]),
    "darcs": ("Author: Jo\n  * Fix\nM ./a.c", [("author", None, None, "Jo"), ("subject", None, None, "Fix"), ("file", "M", "./a.c", None)]),
    "gh": ("Showing 2 of 9 open issues\n#12\tBug\topen", [("summary", None, None, "2"), ("item", None, None, "12")]),
    "glab": ("!7\tFix", [("item", None, None, "7")]),
    "az": ('"pullRequestId": 9,\n"title": "Fix",\n"status": "active",', [("item", None, None, "9"), ("subject", None, None, "Fix"), ("status", "active", None, None)]),
    "bitbucket": ("Pull request #4: Fix", [("item", None, None, "4")]),
    "gerrit": ("change I" + "a" * 40 + "\n  subject: Fix\n  status: NEW", [("item", None, None, "I" + "a" * 40), ("subject", None, None, "Fix"), ("status", "NEW", None, None)]),
    "repo": ("project a/b/ branch x\n -m\tc.c", [("project", None, "a/b", "x"), ("file", "-m", "c.c", None)]),
    "svn": ("r5 | jo | 2026-01-01 10:00:00 +0000 | 1 line\nM       a.c\nIndex: b.c", [("commit", None, None, "5"), ("file", "M", "a.c", None), ("diff_file", None, "b.c", None)]),
}
for _tool, (_t, _rows) in _VCS.items():
    QUERIES[f"fmt_vcs_{_tool}"] = (
        lambda spark, sf, _tool=_tool, _t=_t: vcs.parse(text(spark, _t), _tool).select("rec_type", "status", "path", "value"), values("rec_type,status,path,value", *_rows))


@query("vcs_tools", values("source_id,tool", (0, "git"), (1, "hg"), (2, "svn"), (3, None)))
def _tools(spark, sf):
    return whole(spark, "On branch main", "changeset:   3:0a1b2c", "Index: a.c", "hello").select("source_id", vcs.tool_of(F.col("text")).alias("tool"))


_RULE = """
output_template = "{{body}} n={{errors}}"
[[sections]]
name = "tests"
enter = "^=== RUN"
exit = "^=== END"
keep = ["ok|fail"]
drop = ["skip"]
[[sections.aggregates]]
name = "fails"
kind = "count"
pattern = "fail"
[[sections.aggregates]]
name = "ms"
kind = "sum"
pattern = "([0-9]+)ms"
"""
_BODY = "x\n=== RUN\nok a 5ms\nfail b 7ms\nskip ok\nnothing\n=== END\nok z 100ms"


@query("rule_lines", values("line_no,line,section", (3, "ok a 5ms", "tests"), (4, "fail b 7ms", "tests")))
def _rule_lines(spark, sf):
    return rules.apply_rule(text(spark, _BODY), rules.load_rule(_RULE))[0].drop("source_id")


@query("rule_aggregates", values("section,name,value", ("tests", "fails", 1.0), ("tests", "ms", 12.0)))
def _rule_sums(spark, sf):
    return rules.apply_rule(text(spark, _BODY), rules.load_rule(_RULE))[1].drop("source_id")


@query("template_rules", values("t", ("GET took 5",), ("other",)))
def _template_rules(spark, sf):
    return spark.createDataFrame([("req GET 5 ms",), ("other",)], "l string").select(rules.template_driven(F.col("l"), [("^req ([A-Z]+) ([0-9]+) ms$", "<*> took <*>")]).alias("t"))


@query("alias_rules", values("value,alias", ("/usr/lib/x", "system"), ("/home/a", None)))
def _aliases(spark, sf):
    return rules.aliases(spark.createDataFrame([("/usr/lib/x",), ("/home/a",)], "value string"), [("system", "^/usr/"), ("tmp", "^/tmp/")])


@query("detect_formats")
def _detect(spark, sf):
    """Every format's confidence for its own kind of text."""
    from ..operators import classify

    t = whole(spark, _JAVA, _PY, _CI, "On branch main", '{"a": 1}')
    return classify.ranking(t, "source_id", "text", list(FORMATS), 5)


@query("section_flip", values("line_no", (2,), (5,)))
def _flip(spark, sf):
    """A line that opens and closes turns the state."""
    return filters.section(text(spark, "=x=\na\n=x=\nb\nc"), "^=x=|^b", "^=x=").select("line_no")


# ---- scalars, sinks and routing ------------------------------------------------------------------

@query("parse_times", values("k,ms", (0, 1767225600000), (1, 1767225600500), (2, 1767225601000), (3, None)))
def _times(spark, sf):
    df = spark.createDataFrame([(0, "x 2026-01-01T00:00:00Z y"), (1, "2026-01-01 00:00:00.5"), (2, "at 1767225601000 ms"), (3, "none")], "k int, t string")
    return df.select("k", F.unix_millis(N.parse_timestamp(F.col("t"))).alias("ms"))


@query("durations", values("k,ms", (0, 200), (1, 12), (2, 1500), (3, None)))
def _ms(spark, sf):
    return spark.createDataFrame([(0, "0.2"), (1, "12ms"), (2, "1.5s"), (3, "-")], "k int, t string").select("k", N.duration_ms(F.col("t")).alias("ms"))


@query("human_counts", values("k,s", (0, "999"), (1, "1.2K"), (2, "3.4M")))
def _human(spark, sf):
    return spark.createDataFrame([(0, 999), (1, 1200), (2, 3_400_000)], "k int, n bigint").select("k", N.human_count(F.col("n")).alias("s"))


@query("apply_patch", values("s", ("a X c Y",)))
def _patch_words(spark, sf):
    return spark.createDataFrame([("a b c d", "1:b->X,3:d->Y,0:z->Q")], "b string, p string").select(N.apply_patch(F.col("b"), F.col("p")).alias("s"))


@query("restore_fuzzy", values("text", ("error at line 9",)))
def _fuzzy(spark, sf):
    from ..operators import inverse

    return inverse.restore_fuzzy(spark.createDataFrame([("error at line 4", "3:4->9")], "base string, patch string"), "base", "patch").select("text")


@query("mask_volatile", values("k,s", (0, "pull [CID] from [IP]"), (1, "~/x [%] done"), (2, "GET /a")))
def _volatile(spark, sf):
    return spark.createDataFrame([(0, "pull 0123456789abcdef from 10.0.0.1"), (1, "/home/jo/x 45% done"), (2, "GET /a?b=c")], "k int, t string").select("k", N.mask_volatile(F.col("t")).alias("s"))


@query("compact_times", values("k,s", (0, "2026-01-01 00:00:05"), (1, "01/Jan/2026:00:00:00"), (2, "a/b/12345678")))
def _compact_times(spark, sf):
    df = spark.createDataFrame([(0, "2026-01-01T00:00:05.123Z"), (1, "01/Jan/2026:00:00:00 +0000"), (2, "a/b/1234567890")], "k int, t string")
    return df.select("k", F.when(F.col("k") == 2, N.compact_stream(F.col("t"))).otherwise(N.compact_time(F.col("t"))).alias("s"))


@query("truncate_values", values("s", ("insert into t values (1,2,3,4...",)))
def _truncate(spark, sf):
    return spark.createDataFrame([("insert into t values (1,2,3,4,5,6,7,8,9)",)], "t string").select(N.truncate_values(F.col("t"), 8).alias("s"))


@query("pipeline_token", values("s", ("$PL stage",)))
def _token(spark, sf):
    return spark.createDataFrame([("[Pipeline] stage",)], "t string").select(N.pipeline_token(F.col("t")).alias("s"))


@query("web_routes", values("k,health,static,sensitive,kind", (0, True, False, False, "health"), (1, False, True, False, "static"), (2, False, False, True, "bot"), (3, False, False, False, "routine")))
def _kinds(spark, sf):
    df = spark.createDataFrame([(0, "/healthz", "-"), (1, "/a/b.CSS", "Mozilla/5.0"), (2, "/wp-admin", "curl/8"), (3, "/x", "Mozilla/5.0")], "k int, r string, u string")
    return df.select("k", N.is_health(F.col("r"), F.col("u")).alias("health"), N.is_static(F.col("r")).alias("static"), N.is_sensitive(F.col("r")).alias("sensitive"), N.routine_kind(F.col("r"), F.col("u")).alias("kind"))


@query("scripts_by_encoding", values("k,primary_script,confidence", (0, "Latin", 1.0), (1, "Cyrillic", 0.8)))
def _by_encoding(spark, sf):
    from ..operators import classify

    df = spark.createDataFrame([(0, "plain", "gbk"), (1, "abcжжж", "windows-1251")], "k int, t string, e string")
    return df.withColumn("s", classify.scripts_with_encoding(F.col("t"), F.col("e"))).select("k", "s.primary_script", "s.confidence")


@query("command_routes", values("k,plugin", (0, "vcs"), (1, "rust_go"), (2, "generic_text")))
def _command_routes(spark, sf):
    from ..operators import classify

    return spark.createDataFrame([(0, "git status"), (1, "cargo test"), (2, "ls")], "k int, c string").select("k", classify.command_route(F.col("c"), [("^git ", "vcs", 10), ("^(cargo|go) ", "rust_go", 5), ("test", "pytest", 1)]).alias("plugin"))


@query("npm_variants", values("k,v", (0, "jest"), (1, "vitest"), (2, "npm_test")))
def _variants(spark, sf):
    from ..operators import classify

    return spark.createDataFrame([(0, "npm test", "Tests: 1 passed, 1 total"), (1, "npx vitest", ""), (2, "npm test", "ok")], "k int, c string, o string").select("k", classify.npm_test_variant(F.col("c"), F.col("o")).alias("v"))


@query("unwrap", values("k,t", (0, "core"), (1, "plain")))
def _unwrap(spark, sf):
    from ..operators import classify

    return spark.createDataFrame([(0, "<a><b>core</b></a>"), (1, "plain")], "k int, x string").select("k", classify.unwrap(F.col("x"), [("^<a>(.*)</a>$", 1), ("^<b>(.*)</b>$", 1)]).alias("t"))


@query("merge_dictionaries", values("dict_type,token,value,n", ("path", "$P1", "/a/b", 5), ("path", "$P2", "/c/d", 1)))
def _merge(spark, sf):
    from ..operators import reduce

    schema = "dict_type string, token string, value string, n bigint"
    return reduce.merge_dictionaries([spark.createDataFrame([("path", "$P1", "/a/b", 2)], schema), spark.createDataFrame([("path", "$P7", "/a/b", 3), ("path", "$P2", "/c/d", 1)], schema)])


@query("common_prefixes", values("prefix,n,children", ("/srv/data/projects/alpha", 2, 2)))
def _common(spark, sf):
    from ..operators import reduce

    return reduce.common_prefixes(spark.createDataFrame([("/srv/data/projects/alpha/x",), ("/srv/data/projects/alpha/y",), ("/tmp/z",)], "path string"))


@query("longest_prefix", values("path,short", ("/srv/app/a/b", "$D1/b"), ("/srv/x", "$D0/x"), ("/tmp/y", "/tmp/y")))
def _longest(spark, sf):
    from ..operators import reduce

    dirs = spark.createDataFrame([("$D0", "/srv"), ("$D1", "/srv/app/a")], "token string, value string")
    return reduce.longest_prefix(spark.createDataFrame([("/srv/app/a/b",), ("/srv/x",), ("/tmp/y",)], "path string"), dirs)


@query("merge_outputs", values("source_id,original_size,compressed_size,base_timestamp,ratio", (0, 20, 5, "t1", 0.25)))
def _merge_outputs(spark, sf):
    from ..sources import sinks

    return sinks.merge_outputs(spark.createDataFrame([(0, 10, 4, None, 0), (0, 10, 1, "t1", 1), (0, 0, 0, "t2", 2)], "source_id int, original_size int, compressed_size int, base_timestamp string, chunk int"))


@query("llm_payload", values("text", ("[DICT]\n$M0=the same long line\n[DATA]\nthe same long line\n$M0",)))
def _payload(spark, sf):
    from ..operators import reduce
    from ..sources import sinks

    tokens, dictionary = reduce.dedup_lines(text(spark, "the same long line\nthe same long line"))
    return sinks.llm_payload(tokens, dictionary).select("text")


@query("ai_export", values("text", ("[Directories]\n$D0: /srv\n$D10: /opt\n[Semantic Logs]\n$D0/x failed",)))
def _export(spark, sf):
    from ..operators import inverse

    dirs = spark.createDataFrame([("$D10", "/opt"), ("$D0", "/srv")], "token string, value string")
    return inverse.ai_export(spark.createDataFrame([(0, "$D0/x failed")], "source_id int, text string"), dirs).select("text")


@query("rehydrate_ai", values("line_no,line", (1, "... Skipped 2 normal build lines ..."), (4, "before"), (5, "request failed with code 7"), (6, "after"), (7, "... Skipped 1 normal build lines ...")))
def _rehydrate(spark, sf):
    from ..operators import inverse

    rows = [(1, "text", "start"), (2, "ref", "$M2"), (3, "text", "more"), (4, "text", "before"), (5, "ref", "$M1"), (6, "text", "after"), (7, "text", "end")]
    tokens = spark.createDataFrame([(0, *r) for r in rows], "source_id int, seq bigint, kind string, value string")
    names = spark.createDataFrame([("$M1", "request failed with code 7"), ("$M2", "usual noise line")], "token string, value string")
    return inverse.rehydrate_for_ai(tokens, names).drop("source_id")


@query("rule_diagnosis", values("code", ("keep_drop_overlap",), ("duplicate_enter",), ("keep_overlap",), ("no_hit",), ("no_hit",)))
def _diagnosis(spark, sf):
    rule = rules.load_rule('[[sections]]\nname="a"\nenter="^x"\nkeep=["k"]\ndrop=["k"]\n[[sections]]\nname="b"\nenter="^x"\nkeep=["k"]')
    return spark.createDataFrame([(d["code"],) for d in rules.diagnose(rule, text(spark, "y"))], "code string")


@query("session_windows", """with p as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select user_id, ts, sum(case when before is null or ts > before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from p)
select min(ts) as start, max(ts) + interval 30 minute as "end", user_id, count(*) as n from s group by user_id, k""")
def _sessions(spark, sf):
    from ..streaming import stream

    out = stream.sessions(spark.read.parquet(f"{sf}/events.parquet"))
    return out.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("start", "end")})


@query("longest_first", values("value", ("ccc",), ("bb",), ("a",)))
def _longest_first(spark, sf):
    from ..operators import reorder

    return reorder.longest_first(spark.createDataFrame([("a",), ("ccc",), ("bb",)], "value string"))
