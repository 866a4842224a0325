"""The formats (PLG-*). Patterns and needles are fixed values: they say what the tools print."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import Format, Record, has, share

ERR = Record("error", r"(?i)(error|fatal|panic|failed|rollback)", {"level": "error", "msg": 0})
TS = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _sum(*pairs):
    def detect(t):
        out = F.lit(0.0)
        for p, w in pairs:
            out = out + F.when(t.rlike(p), float(w)).otherwise(0.0)
        return F.round(F.least(out, F.lit(0.99)), 6)
    return detect


FORMATS = (
    Format("android_gradle", 0, lambda t: has(t, "> task :", "removing resource", score=0.8), (
        Record("task", r"^> Task (:[^ ]+)(?: (FAILED|UP-TO-DATE|FROM-CACHE|SKIPPED|NO-SOURCE))?", {"key": 1, "level": 2}),
        Record("resource", r"warn: removing resource ([A-Za-z0-9_.]+):([A-Za-z0-9_]+)/([A-Za-z0-9_]+) without default value", {"key": 1, "msg": 3}),
        Record("env", r"^([A-Z0-9_]+)=(.*)$", {"key": 1, "msg": 2}), Record("download", r"^Download (https?://[^ ]+)", {"msg": 1})), by=("kind", "level")),
    Format("ansible", 1, lambda t: has(t, "task [", "play [", "play recap"), (
        Record("host", r"^(ok|changed|failed|unreachable|skipping|fatal): \[([^\]]+)\](?:: [A-Z]+!)?(?:[ \t]*=>[ \t]*(.+))?", {"level": 1, "key": 2, "msg": 3}),
        Record("recap", r"^([^ \t]+)[ \t]+:[ \t]+(ok=.+)$", {"key": 1, "msg": 2})), context=r"^(?:TASK|RUNNING HANDLER) \[(.+?)\]", by=("context", "kind", "level")),
    Format("ansi_cleaner", 2, lambda t: F.lit(0.1)),
    Format("artifact_summary", 3, lambda t: F.when(t.rlike(r"<testsuites?[ >]") | (t.rlike(r'"runs"') & t.rlike(r'sarif')), 1.0).otherwise(0.0)),
    Format("bazel", 4, lambda t: has(t, "bazel ", "info: analyzed", "info: elapsed time"), (
        Record("target", r"^(//[^ ]+).*(PASSED|FAILED)", {"key": 1, "level": 2}), Record("info", r"^INFO: (Analyzed|Found|Elapsed time|Build completed|Build did NOT complete)(.*)$", {"key": 1, "msg": 2}),
        Record("version", r"^Build (label|target): (.+)$", {"key": 1, "msg": 2}), ERR)),
    Format("cloud_log", 5, _sum((r'"(textPayload|jsonPayload|logStreamName|insertId|ingestionTime)"', 0.5), (r"(?m)^[0-9]{4}-[0-9]{2}-[0-9]{2}T[^ ]+ +(INFO|WARN|WARNING|ERROR|DEBUG) ", 0.4), (r'"severity"', 0.3)), (
        Record("json", r'^\{.*"(?:severity|level|levelname)"[ ]*:[ ]*"([A-Za-z]+)".*"(?:textPayload|message|msg)"[ ]*:[ ]*"([^"]*)"', {"level": 1, "msg": 2}),
        Record("text", rf"^({TS}T[^ ]+)[ ]+(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|CRITICAL|NOTICE)[ ]+([^ ]+)[ ]+(.+)$", {"value": 1, "level": 2, "key": 3, "msg": 4}),
        Record("lambda", rf"^\[([A-Z]+)\][ ]+({TS}T[^ ]+Z)[ ]+([a-f0-9-]+)[ ]+(.+)$", {"level": 1, "value": 2, "key": 3, "msg": 4}),
        Record("python", rf"^\[({TS} [0-9:,]+)\][ ]+([A-Z]+):[ ]+(.+)$", {"value": 1, "level": 2, "msg": 3}),
        Record("stream", rf"^({TS}T[^ ]+)[ ]+([^ ]+)[ ]+(.+)$", {"value": 1, "key": 2, "msg": 3})), by=("kind", "level")),
    Format("cloudformation", 6, lambda t: has(t, "aws::", "create_complete", "create_in_progress", "stack events", "update_rollback", "create_failed"), (
        Record("event", r"^([A-Z0-9]+_[A-Z0-9_]+)[ \t]+([A-Za-z0-9-]+)[ \t]*(.*)$", {"level": 1, "key": 2, "msg": 3}),), by=("kind", "level")),
    Format("ci_log", 7, lambda t: has(t, "::group::", "::endgroup::", "::error", "running with gitlab-runner", "section_start:", "[pipeline]", "##[section]", "##[error]", "##teamcity[", "travis_fold:", "process completed with exit code", "finished: failure", "exited with code", score=0.94), (
        Record("end", r"^(::endgroup::|section_end:)", {"key": 1}), Record("step", r"^(?:::group::|##\[section\]|### step: ?)(.+)$", {"key": 1}),
        Record("error", r"(?i)(::error|##\[error\]|\berror\b|failed|fatal)", {"level": "error", "msg": 0}), Record("warning", r"(?i)(::warning|\bwarn(ing)?\b)", {"level": "warning", "msg": 0}),
        Record("cache", r"(?i)cache (restored|saved|hit|miss)", {"key": 1}), Record("artifact", r"(?i)artifact", {}), Record("retry", r"(?i)(retrying|re-running|job retry|retry attempt)", {}), Record("line", r".", {})),
        context=r"^(?:::group::|##\[section\]|### step: ?)(.+)$", by=("context", "kind")),
    Format("db_log", 8, lambda t: F.when(share(t, rf"^{TS}[ T][0-9:.]+(Z| [A-Z]+)?[ ]+\[?[0-9]+\]?[ ]+\[?[A-Za-z]+|^[0-9]+:[A-Z] [0-9]|\"ctx\"", 10) >= 0.3, 0.9).otherwise(0.0), (
        Record("pg_duration", rf"^({TS} [0-9:.]+ [A-Z]+)[ ]+\[([0-9]+)\][ ]+LOG:[ ]+duration:[ ]+([0-9.]+)[ ]+ms[ ]+(.*)$", {"key": 2, "value": 3, "level": "LOG", "msg": 4}),
        Record("pg", rf"^({TS} [0-9:.]+ [A-Z]+)[ ]+\[([0-9]+)\][ ]+([A-Z]+):[ ]+(.*)$", {"key": 2, "level": 3, "msg": 4}),
        Record("mysql", rf"^({TS}T[0-9:.]+Z)[ ]+([0-9]+)[ ]+\[([A-Za-z]+)\][ ]+(.*)$", {"key": 2, "level": 3, "msg": 4}),
        Record("mongo", r'"ctx"[ ]*:[ ]*"([^"]+)".*"msg"[ ]*:[ ]*"([^"]+)"', {"key": 1, "msg": 2}),
        Record("redis", r"^([0-9]+):([A-Z])[ ]+([0-9]{1,2} [A-Za-z]+ [0-9]{4} [0-9:.]+)[ ]+([*#-])[ ]+(.*)$", {"key": 1, "level": 4, "msg": 5})), by=("kind", "level")),
    Format("dotnet", 9, _sum((r"(?m)^\s*at [A-Za-z0-9_.<>]+\(.*\) in .*:line [0-9]+", 0.5), (r"error CS[0-9]+", 0.4), (r"MSBuild|\.csproj", 0.3)), (
        Record("error", r"^(.*)\(([0-9]+),([0-9]+)\):[ ]+error[ ]+(CS[0-9]+):[ ]+(.*)$", {"file": 1, "ln": 2, "key": 4, "level": "error", "msg": 5}),
        Record("frame", r"^at[ ]+([A-Za-z0-9_.<>]+)\((.*)\)(?:[ ]+in[ ]+(.*?):line[ ]+([0-9]+))?", {"key": 1, "file": 3, "ln": 4}))),
    Format("gcc_log", 10, _sum((r":[0-9]+:[0-9]+: (warning|error|note|fatal error): ", 0.6), (r"\b(gcc|g\+\+|clang)\b", 0.3), (r"make\[[0-9]+\]", 0.2), (r"undefined reference to", 0.3)), (
        Record("diagnostic", r"(?:^|\]\s*)([^:\[\]]+):([0-9]+):([0-9]+):[ ]*(error|warning|note|fatal error): (.*?)(?: \[(-W[^\]]+)\])?$", {"file": 1, "ln": 2, "level": 4, "msg": 5, "key": 6}),
        Record("linker", r"^(.+):\(([^)]+)\): undefined reference to [`']([^`']+)[`']", {"file": 1, "key": 3, "level": "error"}),
        Record("ninja", r"^\[([0-9]+)/([0-9]+)\][ ]+(.+)$", {"value": 1, "msg": 3}), Record("cmake", r"^\[[ ]*([0-9]+)%[ ]*\](.*)$", {"msg": 2}), Record("make", r"^make\[([0-9]+)\]: (.*)$", {"key": 1, "msg": 2})), by=("kind", "level", "key")),
    Format("helm", 11, lambda t: has(t, "last deployed:", "helm ", "revision:"), (
        Record("field", r"^(NAME|LAST DEPLOYED|NAMESPACE|STATUS|REVISION|TEST SUITE|Last Started|Last Completed|Phase):[ ]*(.*)$", {"key": 1, "msg": 2}), Record("resource", r"^((?:deployment|service|configmap|secret)/[^ ]+)", {"key": 1}), ERR)),
    Format("java_stack", 12, lambda t: F.when(t.rlike(r"(?m)^\s*at [A-Za-z0-9_.$]+\([^)]*\.java:[0-9]+\)"), 0.95).when(t.rlike("Exception in thread"), 0.9).otherwise(0.0), (
        Record("head", r"^(?:Exception in thread \"([^\"]*)\" )?([a-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_$]+)+(?:Exception|Error|Throwable))(?::[ ]*(.*))?$", {"value": 1, "key": 2, "msg": 3}),
        Record("frame", r"^at ([A-Za-z0-9_.$<>]+)\(([^:)]*)(?::([0-9]+))?\)", {"key": 1, "file": 2, "ln": 3}), Record("cause", r"^Caused by: ([A-Za-z0-9_.$]+)(?::[ ]*(.*))?", {"key": 1, "msg": 2}), Record("suppressed", r"^Suppressed: ([A-Za-z0-9_.$]+)", {"key": 1}))),
    Format("json", 13, lambda t: F.when(t.rlike(r"(?s)^\s*[\{\[].*[\}\]]\s*$") & F.try_parse_json(t).isNotNull(), 1.0).when(t.rlike(r"\{\s*\"[^\"]+\"\s*:"), 0.85).otherwise(0.0)),
    Format("kubernetes_docker", 14, _sum((r"[A-Za-z0-9-]+/[A-Za-z0-9-]+-[a-z0-9]{5,10}-[a-z0-9]{5}", 0.5), (r"\b[0-9a-f]{64}\b", 0.3), (r"(?i)kubelet|container|pod/", 0.3)), (
        Record("pod", r"([A-Za-z0-9-]+)/([A-Za-z0-9-]+-[a-z0-9]{5,10}-[a-z0-9]{5})", {"key": 1, "msg": 2}), Record("container", r"\b([0-9a-f]{12,64})\b", {"key": 1}))),
    Format("ndjson", 15, lambda t: F.when(share(t, r"^\s*\{.*\}\s*$", 1000) >= 0.8, F.when(t.rlike(r'"Action"\s*:'), 0.95).otherwise(0.85)).otherwise(0.0)),
    Format("markdown", 16, _sum((r"(?m)^#{1,6} ", 0.4), (r"\[[^\]]+\]\([^)]+\)", 0.3), (r"!\[[^\]]*\]\(", 0.3), (r"(?m)^\s*[-*] ", 0.2))),
    Format("maven", 17, _sum((r"(?m)^\[(INFO|WARNING|ERROR)\] ", 0.5), (r"BUILD (SUCCESS|FAILURE)", 0.6), (r"Tests run: [0-9]+", 0.6)), (
        Record("javac", r"^\[(WARNING|ERROR)\][ ]+([^:]+):\[([0-9]+),([0-9]+)\][ ]+(.+)$", {"level": 1, "file": 2, "ln": 3, "msg": 5}),
        Record("tests", r"^\[[A-Z]+\][ ]+Tests run:[ ]+([0-9]+),[ ]+Failures:[ ]+([0-9]+),[ ]+Errors:[ ]+([0-9]+),[ ]+Skipped:[ ]+([0-9]+)", {"value": 1, "key": 2, "msg": 3, "ln": 4}),
        Record("download", r"^Download(?:ing|ed) from [A-Za-z0-9_-]+: +(https?://.*)$", {"msg": 1}), Record("result", r"BUILD (SUCCESS|FAILURE)", {"level": 1})), by=("kind", "level")),
    Format("node_error", 18, lambda t: F.when(share(t, r"^[A-Z][A-Za-z0-9_]*(Error|Exception): |^\s*at [^ ]+ \(", 10) >= 0.4, 0.85).when(t.rlike(r"(?m)^[A-Z][A-Za-z0-9_]*(Error|Exception): "), 0.8).otherwise(0.0), (
        Record("error", r"^([A-Z][A-Za-z0-9_]*(?:Error|Exception)): (.*)$", {"key": 1, "level": "error", "msg": 2}), Record("frame", r"^at ([^ ]+) \(([^:]+)(?::([0-9]+):([0-9]+))?\)$", {"key": 1, "file": 2, "ln": 3}))),
    Format("nodejs", 19, lambda t: has(t, "npm err!", "npm warn", "yarn install", "pnpm ", "added ", "eslint", "test suites:", score=0.85), (
        Record("deprecated", r"^npm (?:WARN|warn) deprecated ([^:]+):", {"key": 1}), Record("added", r"^added ([0-9]+) packages?(?:.* in (.+))?$", {"value": 1, "msg": 2}), Record("vulnerable", r"^([0-9]+) vulnerabilit", {"value": 1}),
        Record("npm_error", r"^npm (?:ERR!|error) (?:code )?(.*)$", {"level": "error", "msg": 1}), Record("tsc", r"^([^(]+)\(([0-9]+),[0-9]+\): error (TS[0-9]+): (.*)$", {"file": 1, "ln": 2, "key": 3, "level": "error", "msg": 4}),
        Record("eslint", r"^([0-9]+):([0-9]+)[ ]+(error|warning)[ ]+(.*?)[ ]+([a-z@/-]+)$", {"ln": 1, "level": 3, "msg": 4, "key": 5}), Record("jest", r"^(Tests|Test Suites):[ ]+(.*)$", {"key": 1, "msg": 2})), by=("kind", "level", "key")),
    Format("noise_filter", 20, lambda t: F.when(F.substring(t, 1, 1024).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), 1.0).when(F.contains(t, F.lit("\r")), 0.95).when(share(t, "^(Generating|Copying|Checking|Installing|Skiped|skipping)", 1000) >= 0.4, 0.7).when(t.rlike("[0-9a-fA-F]{32,}"), 0.6).otherwise(0.0)),
    Format("generic_text", 21, lambda t: F.when(F.trim(t) != "", 0.11).otherwise(0.0)),
    Format("php_ruby", 22, lambda t: F.when(t.rlike(r"PHP (Fatal|Warning|Notice|Parse)|Stack trace:\s*#0"), 0.95).when(t.rlike(r"(?m)^\s*from .*\.rb:[0-9]+"), 0.9).otherwise(0.0), (
        Record("php", r"PHP (Fatal error|Warning|Notice|Parse error):[ ]+(.*?)(?: in ([^ ]+) on line ([0-9]+))?$", {"level": 1, "msg": 2, "file": 3, "ln": 4}), Record("frame", r"^(?:#[0-9]+|from) ([^:(]+)[:(]([0-9]+)", {"file": 1, "ln": 2}))),
    Format("protobuf", 23, lambda t: F.when(t.rlike(r"\.proto:[0-9]+:"), 0.9).otherwise(0.0), (Record("diagnostic", r"^([^: \t]+\.proto):([0-9]+):(?:([0-9]+):)?[ ]*(warning|error):[ ]*(.+)$", {"file": 1, "ln": 2, "level": 4, "msg": 5}),), by=("kind", "level")),
    Format("pulumi", 24, lambda t: has(t, "pulumi", "previewing update", "updating ("), (Record("resource", r"^([+\-~])[ ]+([A-Za-z0-9_./-]+:[A-Za-z0-9_:./-]+)[ ]+([A-Za-z0-9_./-]+)", {"level": 1, "key": 2, "msg": 3}), Record("summary", r"^Resources:(.*)$", {"msg": 1}), ERR), by=("kind", "level")),
    Format("pytest", 25, lambda t: has(t, "test session starts", "short test summary info", "pytest"), (
        Record("test", r"^([^ ]+::[^ ]+)[ ]+(PASSED|FAILED|SKIPPED|ERROR|XFAIL|XPASS|RERUN)\b", {"key": 1, "level": 2}),
        Record("test", r"^\[gw[0-9]+\][ ]+\[[ ]*[0-9]+%\][ ]+(PASSED|FAILED|SKIPPED|ERROR|RERUN)[ ]+([^ ]+::[^ ]+)", {"level": 1, "key": 2}), Record("collected", r"^collected ([0-9]+)", {"value": 1}), Record("summary", r"^=+ (.*(?:passed|failed).*) =+$", {"msg": 1})), by=("kind", "level")),
    Format("python_traceback", 26, lambda t: F.when(t.rlike(r"Traceback \(most recent call last\):"), 0.9).otherwise(0.0), (
        Record("head", r"^Traceback \(most recent call last\):", {}), Record("frame", r'^File "([^"]+)", line ([0-9]+), in (.+)', {"file": 1, "ln": 2, "key": 3}), Record("exception", r"^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Warning|Interrupt|Exit)): (.*)$", {"key": 1, "level": "error", "msg": 2}))),
    Format("rust_go", 27, lambda t: F.when(share(t, r"^\s*(Compiling|Finished|error\[E|warning:|-->|test |running [0-9]+ tests|--- (PASS|FAIL)|goroutine |ok\s)", 15) >= 0.3, 0.9).otherwise(0.0), (
        Record("compiling", r"^Compiling ([^ ]+)", {"key": 1}), Record("code", r"^error\[(E[0-9]+)\]: (.*)$", {"key": 1, "level": "error", "msg": 2}), Record("cargo_test", r"^test ([^ ]+) \.\.\. (ok|FAILED|ignored)$", {"key": 1, "level": 2}),
        Record("go_test", r"^--- (PASS|FAIL|SKIP): ([^ ]+) \(([0-9.]+)s\)", {"level": 1, "key": 2, "value": 3}), Record("place", r"^-->[ ]*([^:]+):([0-9]+):([0-9]+)$", {"file": 1, "ln": 2}), Record("goroutine", r"^goroutine[ ]+([0-9]+)[ ]+\[([^\]]+)\]:$", {"value": 1, "level": 2})), by=("kind", "level")),
    Format("shell_session", 28, lambda t: has(t, "$ ", "ps c:\\", "# ", score=0.4), (Record("command", r"^(?:[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:?\s*[~/A-Za-z0-9_.-]*\s*[%#$>]+|\+|PS [A-Z]:\\[^>]*>|[A-Z]:\\[^>]*>|\$)\s+(.*)$", {"msg": 1}), Record("env", r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)$", {"key": 1, "msg": 2}))),
    Format("smart_code", 29, lambda t: has(t, "function ", "class ", "def ", "import ", score=0.8)),
    Format("smart_path", 30, lambda t: F.when(F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\")), 0.9).otherwise(0.0)),
    Format("spring_boot", 31, _sum((r"--- \[[^\]]*\] [A-Za-z0-9_.]+ +:", 0.6), (r"Started [A-Za-z0-9]+ in [0-9.]+ seconds", 0.5), (r"(?m)^Download(ing|ed) from", 0.4)), (
        Record("log", r"^(.*?)[ ]+(TRACE|DEBUG|INFO|WARN|ERROR)[ ]+.*[ ]+---[ ]+\[(.*?)\][ ]+([A-Za-z0-9_.]+)[ ]+:[ ]+(.*)$", {"level": 2, "value": 3, "key": 4, "msg": 5}), Record("download", r"^Download(?:ing|ed) from [A-Za-z0-9_-]+: +(https?://.*)$", {"msg": 1})), by=("kind", "level")),
    Format("sql", 32, lambda t: F.when((F.regexp_count(t, F.lit(r"(?i)\b(select|insert|update|delete|from|where|join)\b")) >= 2), 0.4).otherwise(0.0)),
    Format("static_rule", 33, lambda t: F.lit(0.0)),
    Format("syslog", 34, lambda t: F.when(share(t, r"^[A-Z][a-z]{2} +[0-9]+ [0-9:]{8} [A-Za-z0-9_.-]+ [A-Za-z0-9_.-]+(\[[0-9]+\])?: ", 5) >= 0.5, 0.9).otherwise(0.0), (
        Record("entry", r"^([A-Z][a-z]{2}[ ]+[0-9]+[ ]+[0-9:]{8})[ ]+([A-Za-z0-9_.-]+)[ ]+([A-Za-z0-9_.-]+)(?:\[([0-9]+)\])?:[ ]+(.*)$", {"file": 2, "key": 3, "ln": 4, "msg": 5}),), by=("kind", "file", "key")),
    Format("template_driven", 35, lambda t: F.lit(0.0)),
    Format("terraform", 36, lambda t: has(t, "terraform", "plan:", "will be created", "will be destroyed"), (
        Record("resource", r'^#[ ]+([A-Za-z0-9_./\-\[\]"]+)[ ]+(?:will be|must be)[ ]+(created|destroyed|updated in-place|replaced|read).*$', {"key": 1, "level": 2}), Record("unknown", r"\(known after apply\)", {}),
        Record("plan", r"Plan:[ ]+([0-9]+)[ ]+to add,[ ]+([0-9]+)[ ]+to change,[ ]+([0-9]+)[ ]+to destroy", {"value": 1, "key": 2, "msg": 3}), ERR), by=("kind", "level")),
    Format("unity_unreal", 37, lambda t: has(t, "unityengine", "unloading ", "logtemp", "loginit", "asset", score=0.8), (Record("asset", r"(?i)^(?:Loading|Loaded|Unloading|Importing)[ ]+(?:asset )?(.*)$", {"msg": 1}), Record("guid", r"\b([A-F0-9]{32})\b", {"key": 1})), by=("kind",)),
    Format("web_log", 38, lambda t: F.when(share(t, r'"(GET|POST|PUT|DELETE|HEAD|PATCH|OPTIONS) [^ ]+ HTTP', 12) >= 0.25, F.least(share(t, r'"(GET|POST|PUT|DELETE|HEAD|PATCH|OPTIONS) [^ ]+ HTTP', 12) + 0.2, F.lit(1.0))).otherwise(0.0)),
    Format("xcode_log", 39, lambda t: F.when(share(t, r"^\s*(CompileC|CompileSwift|Ld|CodeSign|cd |/.*clang)|\(in target ", 20) >= 0.2, 0.9).otherwise(0.0), (
        Record("probe", r"/dev/null", {}), Record("task", r"^([A-Z][A-Za-z0-9]+) .*\(in target '([^']+)'", {"key": 1, "level": 2}), Record("cd", r"^cd (.+)$", {"msg": 1}), Record("response", r"@([^ ]+\.(?:rsp|resp))", {"msg": 1})), by=("kind", "key")),
    Format("webpack_vite", 40, lambda t: F.when(t.rlike(r"(?i)webpack [0-9.]+ compiled|vite v[0-9]"), 0.9).when(t.rlike(r"(?i)module not found|\bchunk\b"), 0.7).otherwise(0.0), (
        Record("error", r"(?i)(Module parse failed|Cannot find module|Module not found)", {"key": 1, "level": "error"}), Record("warning", r"(?i)^warning in (.*)$", {"level": "warning", "msg": 1}),
        Record("asset", r"^(?:asset )?([^ ]+\.(?:js|css|html|map))[ ]+([0-9.]+)[ ]*(KiB|MiB|kB|MB)", {"key": 1, "value": 2, "level": 3})), by=("kind", "level")),
    Format("xml_html", 41, lambda t: F.when((F.regexp_count(F.substring(t, 1, 1000), F.lit("<")) > 1) & (F.regexp_count(F.substring(t, 1, 1000), F.lit(">")) > 1) & F.contains(F.substring(t, 1, 1000), F.lit("</")), 0.8).otherwise(0.0)),
    Format("vcs", 42, lambda t: F.when(t.rlike(r"(?m)^On branch |^Changes (not staged|to be committed)"), 0.99).when(t.rlike(r"(?m)^commit [0-9a-f]{40}"), 0.95).when(t.rlike(r"(?m)^diff --git |^Index: "), 0.9).when(t.rlike(r"(?m)^[ MADRCU?!]{2} [^ ]+$"), 0.6).otherwise(0.0)),
    Format("git_diff", 43, _sum((r"(?m)^diff --git ", 0.6), (r"(?m)^--- ", 0.2), (r"(?m)^\+\+\+ ", 0.2), (r"(?m)^@@ ", 0.5)), (
        Record("file", r"^diff --git a/(.*) b/(.*)$", {"key": 1, "file": 2}), Record("hunk", r"^@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@", {"ln": 2}), Record("add", r"^\+(?!\+\+)", {"level": "+"}), Record("del", r"^-(?!--)", {"level": "-"})), context=r"^diff --git a/.* b/(.*)$", by=("context", "kind"), trim=False),
    Format("yaml", 44, lambda t: F.when(share(t, r"^\s*(- )?[A-Za-z0-9_.-]+:( |$)|^---$|^\s*- ", 20) >= 0.85, 0.85).otherwise(0.0)),
)
BY_NAME = {f.name: f for f in FORMATS}
