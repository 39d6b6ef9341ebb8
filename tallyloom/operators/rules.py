"""Validation: rules are rows of a small table, evaluated by one join with the observations and one grouping, whatever their number.

observations: entity_id, value_year, label, metric, value, table_type, ordinal (their order: the first observation of a metric counts).
Issues: entity_id, value_year, rule_name, severity, expected, actual (numbers) and expected_text, actual_text (what is no number).

Results for odd input: null values and metrics are no observations; a rule that lacks its value or one of its terms is silent;
null types match nothing but rules of any statement; an entity without a rule's part has the part's issue.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import amounts_match, parse_amount, table_scale, years
from ..functions.text import normalize_text, snake_key, strip
from ..plans import dims
from ..plans.scratch import dealt, kept
from . import grid
from .labels import canonical

KEY = ["entity_id", "value_year"]
ISSUE = [*KEY, "rule_name", "severity", "expected", "actual", "expected_text", "actual_text"]


def _types(scopes: str) -> list[str]:
    return [t for s in scopes.split(",") if s for t in dims.SCOPES[s]]


def _matches(key: Column, types: Column) -> Column:
    """P7 of a table type's key against a column of types; no types are all."""
    return (F.size(types) == 0) | F.coalesce(F.exists(types, lambda t: key.contains(t) | F.contains(t, key)), F.lit(False))


def _known(facts: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(m, a, k) for k, (m, a) in enumerate((m, a) for m, xs in aliases.items() for a in xs)]
    known = canonical(facts, facts.sparkSession.createDataFrame(rows, "metric string, alias string, ordinal int"))
    return known.withColumn("metric", F.coalesce("metric", snake_key(F.col("label")))).withColumn("value", F.col("value").cast("double"))


def named(facts: DataFrame, aliases: Mapping[str, Sequence[str]] = dims.METRIC_LABELS) -> DataFrame:
    """V1, fact mode: the metric that a fact's label names (L9), else its snake key."""
    return _known(facts.where("value is not null"), aliases)


def read_grids(cells: DataFrame, aliases: Mapping[str, Sequence[str]] = dims.METRIC_LABELS) -> DataFrame:
    """V1, grid mode: the first number of each row whose label names a metric; columns of note references and years don't count, the table's scale does.

    cells: entity_id, value_year, page_number, table_index, row_index, col_index, cell, table_type; a table's rows are few.
    """
    table = Window.partitionBy(*KEY, *grid.TABLE)
    t = strip(F.coalesce("cell", F.lit("")))
    c = cells.withColumn("t", t).withColumn("place", F.struct("row_index", "col_index"))
    c = c.withColumn("scale", F.coalesce(F.min_by(table_scale(F.col("t")), F.when(table_scale(F.col("t")).isNotNull(), F.col("place"))).over(table), F.lit(1)).cast("long"))
    c = c.withColumn("aside", F.max(normalize_text(F.col("t")).isin("note", "notes", "reference", "ref")).over(Window.partitionBy(*KEY, *grid.TABLE, "col_index")))
    number = parse_amount(F.col("t"), F.col("scale"), percent_divides=True, repair=False)
    plain_year = F.replace(F.col("t"), F.lit(","), F.lit("")).rlike(r"^(?:19|20)[0-9]{2}$")
    c = c.withColumn("number", F.when(~F.col("aside") & ~plain_year, number))
    label = F.when(F.col("t").rlike("[A-Za-z]"), F.struct("col_index", "t"))
    r = c.groupBy(*KEY, *grid.TABLE, "row_index", "table_type").agg(F.min(label).alias("l"), F.min(F.when(F.col("number").isNotNull(), F.struct("col_index", "number"))).alias("v"))
    r = r.where("l is not null and v is not null").select(*KEY, "table_type", *grid.TABLE, "row_index", F.col("l.t").alias("label"), F.col("v.number").alias("value"), F.struct("page_number", "table_index", "row_index").alias("ordinal"))
    rows = [(m, a, k) for k, (m, a) in enumerate((m, a) for m, xs in aliases.items() for a in xs)]
    return canonical(r, cells.sparkSession.createDataFrame(rows, "metric string, alias string, ordinal int")).where("metric is not null")


def catalogue(spark: SparkSession) -> DataFrame:
    """The rules that compare numbers: (rule_name, severity, kind, role, sign, metric, types), a row for each value they need."""

    def ref(x: str) -> tuple[str, list[str]]:
        scopes, metric = x.split(":")
        return metric, _types(scopes)

    rows = []
    for name, severity, actual, terms in dims.SUM_RULES:
        rows.append((name, severity, "sum", "actual", 0, *ref(actual)))
        rows += [(name, severity, "sum", f"term{k}", 1 if t[0] == "+" else -1, *ref(t[1:])) for k, t in enumerate(terms.split())]
    for name, severity, actual, over, under in dims.RATIO_RULES:
        rows += [(name, severity, "ratio", role, 0, *ref(x)) for role, x in (("actual", actual), ("over", over), ("under", under))]
    return spark.createDataFrame(rows, "rule_name string, severity string, kind string, role string, sign int, metric string, types array<string>")


def _issue(name: Column, severity: Column, expected: Column | None = None, actual: Column | None = None, expected_text: Column | None = None, actual_text: Column | None = None) -> list[Column]:
    none, said = F.lit(None).cast("double"), F.lit(None).cast("string")
    pick = lambda x, other: other if x is None else x
    return [*map(F.col, KEY), name.alias("rule_name"), F.lower(severity).alias("severity"), F.round(pick(expected, none), 4).alias("expected"), F.round(pick(actual, none), 4).alias("actual"), pick(expected_text, said).alias("expected_text"), pick(actual_text, said).alias("actual_text")]


def compared(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Sums and ratios. Each value that a rule needs is the first observation of its metric in the rule's statements."""
    # rules and what they need go by numbers through the groupings; their names join what is found. They are dealt before they are
    # grouped: a task that made them from wide rows would hold a group for each
    rank = lambda *names: F.dense_rank().over(Window.orderBy(*names))
    size = Window.partitionBy("rule_name")
    rules = rules.withColumn("needs", F.count("*").over(size).cast("int")).withColumn("rule", rank("rule_name", "severity", "kind")).withColumn("need", rank("rule_name", "severity", "kind", "role", "sign"))
    keyed = observations.select(*KEY, "metric", "ordinal", "value", snake_key(F.col("table_type")).alias("key"))
    met = keyed.join(F.broadcast(rules.select("metric", "types", "rule", "need")), "metric").where(_matches(F.col("key"), F.col("types")))
    first = dealt(met.select(*KEY, "rule", "need", "ordinal", "value"), "needs", *KEY, "rule").groupBy(*KEY, "rule", "need").agg(F.min_by("value", "ordinal").alias("value"))
    g = first.join(F.broadcast(rules.select("need", "role", "sign").distinct()), "need").groupBy(*KEY, "rule").agg(
        F.count("*").alias("have"),
        F.max(F.when(F.col("role") == "actual", F.col("value"))).alias("actual"),
        F.sum(F.col("sign") * F.col("value")).alias("total"),
        F.max(F.when(F.col("role") == "over", F.col("value"))).alias("over"),
        F.max(F.when(F.col("role") == "under", F.col("value"))).alias("under"),
    )
    g = g.join(F.broadcast(rules.select("rule", "rule_name", "severity", "kind", "needs").distinct()), "rule")
    ratio, zero = F.col("kind") == "ratio", F.col("under") == 0
    expected = F.when(ratio, F.col("over") / F.nullif(F.col("under"), F.lit(0.0))).otherwise(F.col("total"))
    g = g.where("have = needs").withColumn("expected", expected)
    close = lambda x: amounts_match(F.col("expected"), x, 0.0001)
    part = F.when(~close(F.col("actual")) & (F.abs("expected") <= 1) & (F.abs("actual") > 1), F.col("actual") / 100).otherwise(F.col("actual"))
    bad = F.when(ratio & zero, True).when(ratio, ~close(part)).otherwise(~amounts_match(F.col("expected"), F.col("actual")))
    zero = ratio & zero
    return g.where(bad).select(*_issue(F.col("rule_name"), F.col("severity"), F.col("expected"), F.when(zero, 0.0).otherwise(F.col("actual")), F.when(zero, "non-zero denominator")))


def _refs(spark: SparkSession, refs: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(x.split(":")[1], _types(x.split(":")[0])) for x in refs], "metric string, types array<string>")


def missing_metrics(observations: DataFrame) -> DataFrame:
    """Critical metrics that an entity's year has not."""
    need = {x.split(":")[1]: _types(x.split(":")[0]) for x in dims.CRITICAL_METRICS}
    o = observations.select(*KEY, "metric", snake_key(F.col("table_type")).alias("key"))
    g = o.groupBy(*KEY).agg(*[F.max(F.coalesce((F.col("metric") == m) & _matches(F.col("key"), F.array(*map(F.lit, types))), F.lit(False))).alias(m) for m, types in need.items()])
    lost = F.array_compact(F.array(*[F.when(~F.col(m), m) for m in need]))
    return g.select(*KEY, F.explode(lost).alias("m")).select(*_issue(F.lit("missing_critical_metric"), F.lit("critical"), expected_text=F.col("m")))


def negatives(observations: DataFrame) -> DataFrame:
    """Values below zero of metrics that can't be; an issue for each observation."""
    met = observations.where("value < 0").join(F.broadcast(_refs(observations.sparkSession, dims.NOT_NEGATIVE)), "metric").where(_matches(snake_key(F.col("table_type")), F.col("types")))
    return met.select(*_issue(F.lit("invalid_negative_value"), F.lit("major"), actual=F.col("value"), expected_text=F.concat("metric", F.lit(" >= 0"))))


def missing_parts(observations: DataFrame) -> DataFrame:
    """V2: parts of statements that no metric and no label speaks of."""
    # a row's label and type are normalized once, whatever the number of parts
    o = observations.select(*KEY, "metric", normalize_text(F.col("label")).alias("said"), snake_key(F.col("table_type")).alias("key"))
    found = []
    for name, scope, metrics, phrases in dims.PARTS:
        typed = _matches(F.col("key"), F.array(*map(F.lit, _types(scope))))
        labelled = F.lit(False)
        for p in phrases:
            labelled = labelled | F.col("said").contains(p)
        found.append(F.max(F.coalesce(typed & (F.col("metric").isin(metrics) | labelled), F.lit(False))).alias(name))
    g = o.groupBy(*KEY).agg(*found)
    lost = F.array_compact(F.array(*[F.when(~F.col(x[0]), x[0]) for x in dims.PARTS]))
    return g.select(*KEY, F.explode(lost).alias("name")).select(*_issue(F.col("name"), F.lit("major"), expected_text=F.lit("section present"), actual_text=F.lit("section missing")))


def duplicate_rows(labels: DataFrame) -> DataFrame:
    """Labels that a table has more than once (entity_id, value_year, page_number, table_index, label), sorted and joined."""
    rows = labels.select(*KEY, *grid.TABLE, normalize_text(F.col("label")).alias("label")).where("label <> ''")
    n = dealt(rows, "labels", *KEY, *grid.TABLE).groupBy(*KEY, *grid.TABLE, "label").count().where("count > 1")
    g = n.groupBy(*KEY, *grid.TABLE).agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("labels"))
    return g.select(*_issue(F.lit("duplicate_rows"), F.lit("minor"), expected_text=F.lit("unique row labels"), actual_text=F.col("labels")))


def unordered_years(cells: DataFrame) -> DataFrame:
    """Rows of a grid whose years, two or more, don't strictly fall."""
    r = cells.groupBy(*KEY, *grid.TABLE, "row_index").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("col_index", years(F.col("cell")).alias("ys")))), lambda x: x["ys"])).alias("ys"))
    falls = F.forall(F.sequence(F.lit(1), F.size("ys") - 1), lambda i: F.get("ys", i - 1) > F.get("ys", i))
    bad = r.where("size(ys) >= 2").where(~falls)
    return bad.select(*_issue(F.lit("year_ordering"), F.lit("minor"), expected_text=F.lit("descending years"), actual_text=F.array_join(F.col("ys").cast("array<string>"), ", ")))


def isolated(entities: DataFrame, groups: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """V3: the issues of all groups of rules; one that can't be planned is a major issue of every entity's year, and the others still count."""
    out = []
    for name, group in groups.items():
        try:
            out.append(group().select(*ISSUE))
        except Exception as e:  # a group's own fault must not end the validation
            out.append(entities.select(*KEY).distinct().select(*_issue(F.lit(name), F.lit("major"), expected_text=F.lit("validator completes"), actual_text=F.lit(str(e).split("\n")[0]))))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def validate(facts: DataFrame, aliases: Mapping[str, Sequence[str]] = dims.METRIC_LABELS) -> DataFrame:
    """V1, V3: all issues of facts (entity_id, value_year, page_number, table_index, label, value, table_type, ordinal)."""
    facts = kept(_known(facts, aliases), "facts")  # each group of rules reads them
    o = facts.where("value is not null")
    return isolated(
        facts,
        {
            "formulas": lambda: compared(o, catalogue(facts.sparkSession)),
            "critical_metrics": lambda: missing_metrics(o),
            "negative_values": lambda: negatives(o),
            "completeness": lambda: missing_parts(o),
            "duplicates": lambda: duplicate_rows(facts),
        },
    )


def scored(issues: DataFrame, entities: DataFrame) -> DataFrame:
    """A11 by entity: 100 less deductions for distinct issues; valid from 80 if none is critical."""
    cost = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in dims.DEDUCTIONS.items()], F.lit(10))
    g = issues.select(*ISSUE).distinct().groupBy("entity_id").agg(F.sum(cost).alias("cost"), F.max(F.col("severity") == "critical").alias("critical"), F.count("*").alias("issues"))
    score = F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))).cast("double")
    return entities.select("entity_id").distinct().join(g, "entity_id", "left").select("entity_id", score.alias("score"), F.coalesce("issues", F.lit(0)).alias("issues"), ((score >= 80) & ~F.coalesce("critical", F.lit(False))).alias("is_valid"))
