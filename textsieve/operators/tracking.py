"""Usage analytics (TRK-*) and command discovery (DSC-*).

Events: (timestamp, command, filter_name, input_bytes, output_bytes, input_tokens, output_tokens, filter_time_ms, exit_code, project)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PRICES = (("claude-4.8", 5.00), ("gpt-5.5", 5.00), ("gemini-3.1-pro", 2.00))
FILTERS = (
    ("git|svn|hg|p4|cvs|bzr|fossil|darcs", None), ("gh", "vcs_github"), ("glab", "vcs_gitlab"), ("bb", "vcs_bitbucket"), ("repo", "vcs_repo"), ("gerrit", "vcs_gerrit"),
    ("cargo|rustc|rustup|rustfmt|clippy", "rust"), ("npm|yarn|pnpm|node", "nodejs"), ("python|python3|pip|pip3|pytest|poetry|uv", "python"), ("go", "golang"), ("java|javac|mvn|gradle", "java"),
    ("gcc|g++|clang|clang++|make|cmake", "cpp"), ("docker", "docker"), ("kubectl", "kubernetes"), ("terraform", "terraform"), ("jest|vitest|mocha|ava", "test_framework"),
)
DEFAULT_SHARE = 0.30


def estimates(df: DataFrame) -> DataFrame:
    """TRK-06: tokens as bytes / 4, saved tokens and percent."""
    return with_saved(df.withColumns({"input_tokens": F.floor(F.col("input_bytes") / 4).cast("bigint"), "output_tokens": F.floor(F.col("output_bytes") / 4).cast("bigint")}))


def with_saved(df: DataFrame) -> DataFrame:
    saved = F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0))
    return df.withColumn("saved", saved).withColumn("saved_pct", F.when(F.col("input_tokens") == 0, 0.0).otherwise(F.round(F.col("saved") * 100.0 / F.col("input_tokens"), 4)))


def _sums() -> list[Column]:
    i, o = F.sum("input_tokens"), F.sum("output_tokens")
    return [F.count(F.lit(1)).alias("runs"), i.alias("input_tokens"), o.alias("output_tokens"), F.greatest(i - o, F.lit(0)).alias("saved"), F.round(F.avg("filter_time_ms"), 4).alias("avg_ms")]


def _pct(df: DataFrame) -> DataFrame:
    return df.withColumn("saved_pct", F.when(F.coalesce("input_tokens", F.lit(0)) == 0, 0.0).otherwise(F.round(F.col("saved") * 100.0 / F.col("input_tokens"), 4)))


def gain(events: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """TRK-01: one row; totals from before tracking are added."""
    out = events.agg(*_sums())
    if legacy is not None:
        old = legacy.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("lr"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("li"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("lo"))
        out = out.crossJoin(F.broadcast(old)).select(  # one row each
            (F.col("runs") + F.col("lr")).alias("runs"), (F.col("input_tokens") + F.col("li")).alias("input_tokens"), (F.col("output_tokens") + F.col("lo")).alias("output_tokens"),
            F.greatest(F.col("input_tokens") + F.col("li") - F.col("output_tokens") - F.col("lo"), F.lit(0)).alias("saved"), "avg_ms")
    return _pct(out)


def daily(events: DataFrame, now: str, days: int = 7) -> DataFrame:
    """TRK-02."""
    since = F.date_sub(F.lit(now).cast("date"), days)
    return _pct(events.where(F.to_date("timestamp") >= since).groupBy(F.to_date("timestamp").alias("day")).agg(*_sums()))


def by_filter(events: DataFrame) -> DataFrame:
    """TRK-03: no filter counts as passthrough."""
    return _pct(events.groupBy(F.coalesce("filter_name", F.lit("passthrough")).alias("filter")).agg(*_sums()))


def retained(events: DataFrame, now: str, days: int = 90) -> DataFrame:
    """TRK-04."""
    return events.where(F.to_date("timestamp") >= F.date_sub(F.lit(now).cast("date"), days))


def prices(totals: DataFrame, per_million=PRICES) -> DataFrame:
    """TRK-07: saved money for each model."""
    listed = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(p)).alias("price")) for m, p in per_million])
    return totals.select("saved", F.explode(listed).alias("p")).select("p.model", F.round(F.col("saved") * F.col("p.price") / 1e6, 6).alias("usd"))


def program(command: Column) -> Column:
    """The program's name: environment assignments and its folder go."""
    w = F.filter(F.split(F.trim(command), "[ \\t]+"), lambda x: ~x.rlike("^[A-Za-z_][A-Za-z0-9_]*=") & ~x.isin("sudo", "env"))
    return F.regexp_replace(F.get(w, F.lit(0)), "^.*/", "")


def filter_of(command: Column) -> Column:
    p = program(command)
    out = F.when((p == "az") & F.contains(command, F.lit("repos")), "vcs_azure")
    for names, label in FILTERS:
        out = out.when(p.isin(*names.split("|")), F.concat(F.lit("vcs_"), p) if label is None else F.lit(label))
    return out


def classify(commands: DataFrame, wrapper: str = "textsieve") -> DataFrame:
    """DSC-01: class already_filtered, filterable (with filter) or no_filter."""
    c = F.trim("command")
    wrapped = c.rlike(f"^{wrapper} |{wrapper} run |SHELL={wrapper}|--shell {wrapper}")
    f = filter_of(c)
    return commands.withColumn("class", F.when(wrapped, "already_filtered").when(f.isNotNull(), "filterable").otherwise("no_filter")).withColumn("filter", F.when(~wrapped, f))


def discover(classified: DataFrame, history: DataFrame) -> DataFrame:
    """DSC-02: groups with estimated savings: the history's percentage for the key, else 30 %; truncated towards zero."""
    w = F.filter(F.split(F.trim("command"), "[ \\t]+"), lambda x: x != "")
    key = F.when(F.col("class") == "filterable", F.col("filter")).otherwise(F.array_join(F.slice(w, 1, 2), " "))
    g = classified.withColumn("key", key).groupBy("class", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
    out = g.join(history.select(F.col("filter").alias("key"), F.col("saved_pct").alias("pct")), "key", "left")
    return out.withColumn("estimated", F.when(F.col("pct").isNotNull(), F.col("output_tokens") * F.col("pct") / 100.0).otherwise(F.col("output_tokens") * DEFAULT_SHARE).cast("bigint"))


def potential(groups: DataFrame) -> DataFrame:
    """DSC-03: the sum over what is not filtered yet."""
    return groups.where("class <> 'already_filtered'").agg(F.coalesce(F.sum("estimated"), F.lit(0)).alias("total"))


def is_transparent(command: Column) -> Column:
    """CMD-01: commands that only prefix another one."""
    return F.regexp_extract(F.trim(command), "^([A-Za-z0-9_.-]+)", 1).isin("sudo", "env", "time", "nice", "nohup", "exec", "command", "builtin")


def strip_env(command: Column) -> Column:
    """CMD-02."""
    return F.regexp_replace(F.trim(command), r"^(?:[A-Za-z_][A-Za-z0-9_]*=(?:'[^']*'|\"[^\"]*\"|[^ \t]*)[ \t]+)+", "")


def split_compound(command: Column) -> Column:
    """CMD-03: the commands of a line at ``&&``, ``||``, ``;`` and ``|`` outside quotes."""
    masked = F.regexp_extract_all(command, F.lit(r"(?:'[^']*'|\"(?:[^\"\\]|\\.)*\"|[^'\";|&]|&(?!&))+"), F.lit(0))
    return F.filter(F.transform(masked, lambda x: F.trim(x)), lambda x: x != "")
