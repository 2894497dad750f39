"""Row scorers: each adds ``success``, ``score``, ``metrics``, ``details`` and ``error`` to rows with an answer and what was expected."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, variant as V
from ..model import METRIC_TYPES, Criterion, Metric, ScorerConfig

Scorer = Callable[[DataFrame, ScorerConfig], DataFrame]
SCORERS: dict[str, Scorer] = {}
#: Characters of a text that details keep.
CLIP = 500
SCORED = ("success", "score", "metrics", "details", "error")


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a scorer under a method name: own scorers plug in the same way."""

    def register(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return register


def score(df: DataFrame, config: ScorerConfig) -> DataFrame:
    """Score rows ``predicted_output``, ``expected_output`` by the configured method."""
    if config.method not in SCORERS:
        raise ValueError(f"unknown scoring method {config.method!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[config.method](df.drop(*SCORED), config)


def condition(value: Column, criterion: Criterion) -> Column:
    """Whether a metric meets a criterion; an absent metric does not, and NaN only differs."""
    target = criterion.value
    if isinstance(target, bool):
        met = (value != 0) == F.lit(target)
    else:
        t, sound = F.lit(float(target)), ~F.isnan(value)
        met = {">=": value >= t, "<=": value <= t, ">": value > t, "<": value < t, "==": value == t, "!=": value != t}[criterion.operator]
        met = (~sound | met) if criterion.operator == "!=" else (sound & met)
    return F.coalesce(met, F.lit(False))


def condition_of(value: Column, criterion: Column) -> Column:
    """``condition`` for a criterion that is a value: a struct of ``operator``, ``value`` and ``flag``, the target as a truth value or null."""
    t, sound = criterion["value"], ~F.isnan(value)
    by_operator = F.when(criterion["operator"] == "!=", ~sound | (value != t))
    for name, met in ((">=", value >= t), ("<=", value <= t), (">", value > t), ("<", value < t), ("==", value == t)):
        by_operator = by_operator.when(criterion["operator"] == name, sound & met)
    return F.coalesce(F.when(criterion["flag"].isNotNull(), (value != 0) == criterion["flag"]).otherwise(by_operator), F.lit(False))


def last_of_names(pairs: Column, name: str) -> Column:
    """An array of structs without those that a later one of the same name replaces."""
    return F.filter(pairs, lambda x, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda y: y[name] == x[name]))


def _judged_by(metrics: Column, criteria: Column) -> tuple[Column, Column, Column]:
    """``judged`` for criteria that are an array of structs in the row."""
    met = F.transform(F.coalesce(criteria, F.array().cast("array<struct<metric:string,operator:string,value:double,flag:boolean>>")), lambda c: F.struct(c["metric"].alias("key"), condition_of(F.try_element_at(metrics, c["metric"]), c).alias("value")))
    share = F.when(F.size(met) == 0, F.lit(1.0)).otherwise(F.size(F.filter(met, lambda m: m["value"])) / F.greatest(F.size(met), F.lit(1)))
    return F.forall(met, lambda m: m["value"]), share, F.map_from_entries(last_of_names(met, "key"))


def judged(metrics: Column, criteria: tuple[Criterion, ...] | Column) -> tuple[Column, Column, Column]:
    """All met, share met, and a map of name to met (the last of equal names); without criteria true, 1 and empty. Criteria may be a column: an array of structs of ``metric``, ``operator``, ``value`` and ``flag``."""
    if isinstance(criteria, Column):
        return _judged_by(metrics, criteria)
    if not criteria:
        return F.lit(True), F.lit(1.0), F.create_map().cast("map<string,boolean>")
    met = [condition(F.try_element_at(metrics, F.lit(c.metric)), c) for c in criteria]
    by_name = dict(zip((c.metric for c in criteria), met, strict=True))
    share = reduce(lambda a, b: a + b, [m.cast("int") for m in met]) / float(len(met))
    return reduce(lambda a, b: a & b, met), share, F.create_map(*[x for k, m in by_name.items() for x in (F.lit(k), m)])


def _metric(root: Column, m: Metric) -> tuple[Column, Column]:
    """Value of a metric, and whether it cannot be read."""
    found = V.field(root, m.name)
    if m.type == "numeric":
        value = F.when(found.isNull(), F.lit(0.0)).otherwise(V.number(found))
        return value, value.isNull()
    if m.type == "binary":
        return V.truthy(found).cast("double"), F.lit(False)
    return F.when(found.isNull(), F.lit(0.5)).otherwise(V.number(found)), F.lit(False)


def _read_metrics(root: Column, metrics: tuple[Metric, ...] | Column) -> tuple[Column, Column]:
    """Metrics by name, the last of equal names, and whether any cannot be read."""
    if isinstance(metrics, Column):
        members = F.when(V.is_object(root), root.cast("map<string,variant>"))
        asked = F.filter(F.coalesce(metrics, F.array().cast("array<struct<name:string,type:string>>")), lambda m: m["type"].isin(*METRIC_TYPES))

        def read(m: Column) -> Column:
            found = F.try_element_at(members, m["name"])
            value = F.when(m["type"] == "binary", V.truthy(found).cast("double")).when(found.isNull(), F.when(m["type"] == "numeric", F.lit(0.0)).otherwise(F.lit(0.5))).otherwise(V.number(found))
            return F.struct(m["name"].alias("key"), value.alias("value"), ((m["type"] == "numeric") & value.isNull()).alias("bad"))

        # transform over one element binds the metrics, so each is read once
        bound = F.element_at(F.transform(F.array(F.transform(asked, read)), lambda x: F.struct(F.map_from_entries(F.transform(last_of_names(x, "key"), lambda y: F.struct(y["key"], y["value"]))).alias("by_name"), F.exists(x, lambda y: y["bad"]).alias("bad"))), 1)
        return bound["by_name"], bound["bad"]
    pairs = [(m, *_metric(root, m)) for m in metrics if m.type in METRIC_TYPES]
    named = {m.name: value for m, value, _ in pairs}
    by_name = F.create_map(*[x for name, value in named.items() for x in (F.lit(name), value)]) if named else F.create_map()
    return by_name.cast("map<string,double>"), reduce(lambda a, b: a | b, [bad for _, _, bad in pairs], F.lit(False))


def setting(config: ScorerConfig, name: str, default: float) -> Column:
    """A number of the settings, which may be columns that are null where the default holds."""
    value = config.settings.get(name, default)
    return F.coalesce(value, F.lit(float(default))) if isinstance(value, Column) else F.lit(float(value))


@scorer("metric_based")
def metric_based(df: DataFrame, config: ScorerConfig) -> DataFrame:
    """Read metrics from a JSON object and hold them against the criteria.

    Numeric metrics that are absent are 0, those that cannot be read make the row an error; binary metrics
    are the truth of the value; judged ones are 0.5 if absent; of metrics of one name the last holds. Malformed JSON in
    the answer or in what was expected makes the row an error, an absent expectation does not. Error rows have score 0 and no metrics.
    """
    read = df.withColumns({"_root": V.parse(F.col("predicted_output")), "_want": V.parse(F.col("expected_output"))})
    by_name, unreadable = _read_metrics(F.col("_root"), config.metrics)
    read = read.withColumns({"_by_name": by_name, "_unreadable": unreadable})
    broken = F.when(F.col("_root").isNull() | (F.col("expected_output").isNotNull() & F.col("_want").isNull()), F.lit("invalid JSON")).when(~V.is_object(F.col("_root")), F.lit("invalid answer: no JSON object")).when(F.col("_unreadable"), F.lit("invalid number in a metric"))
    read = read.withColumn("error", broken.otherwise(F.lit(None)))
    read = read.withColumn("metrics", F.when(F.col("error").isNull(), F.col("_by_name")).otherwise(F.create_map().cast("map<string,double>")))
    ok = F.col("error").isNull()
    success, share, status = judged(F.col("metrics"), config.criteria)
    details = F.to_json(F.struct(F.col("_root").alias("predicted"), F.col("_want").alias("expected"), status.alias("criteria_met")))
    return read.select(*df.columns, (ok & success).alias("success"), F.when(ok, share).otherwise(F.lit(0.0)).alias("score"), "metrics", F.when(ok, details).alias("details"), "error")


def _scored(df: DataFrame, success: Column, value: Column, details: Column, metrics: Column | None = None, error: Column | None = None) -> DataFrame:
    """The columns of a scored row; where there is an error the row fails with score 0, without metrics and details."""
    none = F.create_map().cast("map<string,double>")
    metrics = none if metrics is None else metrics
    if error is None:
        return df.select("*", success.alias("success"), value.cast("double").alias("score"), metrics.alias("metrics"), details.alias("details"), F.lit(None).cast("string").alias("error"))
    ok = error.isNull()
    return df.select("*", (ok & success).alias("success"), F.when(ok, value.cast("double")).otherwise(F.lit(0.0)).alias("score"), F.when(ok, metrics).otherwise(none).alias("metrics"), F.when(ok, details).alias("details"), error.alias("error"))


def parsed(df: DataFrame) -> DataFrame:
    """Add ``_a`` and ``_b``: answer and expectation as JSON values, null where they are none in full. Each is parsed once."""
    return df.withColumns({"_a": V.parse(F.col("predicted_output")), "_b": V.parse(F.col("expected_output"))})


def same(a: Column, b: Column, va: Column, vb: Column) -> Column:
    """Equal as texts, or as values if both are JSON in full."""
    return a.eqNullSafe(b) | F.coalesce(V.canonical(va) == V.canonical(vb), F.lit(False))


@scorer("exact_match")
def exact_match(df: DataFrame, config: ScorerConfig) -> DataFrame:
    """1 if answer and expectation are equal (texts, or JSON values whatever their layout), else 0."""
    a, b = F.col("predicted_output"), F.col("expected_output")
    # equal texts and such that no JSON value begins like need no reading
    unlike = ~a.eqNullSafe(b) & a.rlike(V.BEGINS) & b.rlike(V.BEGINS)
    read = df.withColumns({"_a": F.when(unlike, V.parse(a)), "_b": F.when(unlike, V.parse(b))})
    read = read.select(*df.columns, same(F.col("predicted_output"), F.col("expected_output"), F.col("_a"), F.col("_b")).alias("_hit"))
    return _scored(read, F.col("_hit"), F.col("_hit").cast("double"), F.to_json(F.struct(F.col("_hit").alias("exact_match")))).drop("_hit")


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets; 1 if both are empty."""
    return T.jaccard(F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b)))


def dict_similarity(left: Column, right: Column) -> Column:
    """Equal members over all member names of two maps of canonical texts; an absent member equals null; 1 if both have none."""
    # a name counts as equal if both have it with one value, or if it is null or absent on both sides
    entries = F.map_zip_with(left, right, lambda _, a, b: a.eqNullSafe(b))
    equal = F.map_values(entries)
    return F.when(F.size(equal) == 0, F.lit(1.0)).otherwise(T.ratio(F.size(F.filter(equal, lambda x: x)), F.size(equal)))


@scorer("partial_match")
def partial_match(df: DataFrame, config: ScorerConfig) -> DataFrame:
    """Similarity of two JSON objects by members, equality of other JSON values, and of anything else similarity of the texts by tokens; success from ``threshold`` (0.8) on."""
    a, b = F.col("predicted_output"), F.col("expected_output")
    va, vb = F.col("_a"), F.col("_b")
    read = parsed(df)
    objects = V.is_object(va) & V.is_object(vb)
    texts = va.isNull() | vb.isNull() | (V.is_text(va) & V.is_text(vb))
    read = read.withColumns({"_kind": F.when(objects, "objects").when(texts, "texts").otherwise("other"), "_l": V.members(va), "_r": V.members(vb)})
    similarity = F.when(F.col("_kind") == "objects", dict_similarity(F.col("_l"), F.col("_r"))).when(F.col("_kind") == "texts", text_similarity(a, b)).otherwise(same(a, b, va, vb).cast("double"))
    read = read.select(*df.columns, similarity.alias("_similarity"))
    threshold = setting(config, "threshold", 0.8)
    details = F.to_json(F.struct(threshold.alias("threshold"), F.col("_similarity").alias("similarity")))
    return _scored(read, F.col("_similarity") >= threshold, F.col("_similarity"), details).drop("_similarity")


def rouge(df: DataFrame, predicted: str = "predicted_output", reference: str = "expected_output") -> DataFrame:
    """Add precision, recall and F-score of unigrams, bigrams and the longest common subsequence, and ``content_coverage``.

    N-grams shared as often as in the text that has them less often are counted by sorting them and comparing numbered ones as sets.
    """
    read = df.withColumns({"_p": T.tokens(F.col(predicted)), "_r": T.tokens(F.col(reference))})
    grams = [(side, n) for side in "pr" for n in (1, 2)]
    read = read.withColumns({f"_{side}{n}": F.sort_array(T.ngrams(F.col(f"_{side}"), n)) for side, n in grams})
    read = read.withColumns({f"_{side}{n}n": T.numbered(F.col(f"_{side}{n}")) for side, n in grams})
    shared = {str(n): F.size(F.array_intersect(f"_p{n}n", f"_r{n}n")) for n in (1, 2)} | {"l": T.lcs("_p", "_r")}
    sizes = {f"_{side}{n}s": F.size(f"_{side}{n}") for side, n in grams} | {f"_{side}ls": F.size(f"_{side}") for side in "pr"}
    counted = read.withColumns({f"_o{n}": value for n, value in shared.items()} | sizes)
    out = {}
    for n in "12l":
        for name, value in zip(("precision", "recall", "f_score"), T.prf(F.col(f"_o{n}"), F.col(f"_p{n}s"), F.col(f"_r{n}s")), strict=True):
            out[f"rouge_{n}_{name}"] = value
    out["content_coverage"] = T.ratio(F.size(F.array_intersect("_p", "_r")), F.size(F.array_distinct("_r")))
    return counted.withColumns(out).select(*df.columns, *out)


@scorer("rouge")
@scorer("summarization")
def summarization(df: DataFrame, config: ScorerConfig) -> DataFrame:
    """F-scores of ROUGE-1, -2 and -L, weighted by ``weight_rouge_1``, ``weight_rouge_2``, ``weight_rouge_l`` (0.2, 0.3, 0.5), held against the criteria.

    The details keep the texts' first 500 characters.
    """
    weights = {k: setting(config, f"weight_{k}", w) for k, w in (("rouge_1", 0.2), ("rouge_2", 0.3), ("rouge_l", 0.5))}
    read = rouge(df)
    made = [c for c in read.columns if c.startswith("rouge_")]
    composite = reduce(lambda a, b: a + b, [w * F.col(f"{k}_f_score") for k, w in weights.items()])
    read = read.withColumn("_composite", composite)
    parts = {"rouge_1": "rouge_1_f_score", "rouge_2": "rouge_2_f_score", "rouge_l": "rouge_l_f_score", "content_coverage": "content_coverage", "composite_score": "_composite"}
    metrics = F.create_map(*[x for k, c in parts.items() for x in (F.lit(k), F.col(c))])
    read = read.withColumn("_metrics", metrics)
    success, _, status = judged(F.col("_metrics"), config.criteria)
    clips = [F.substring(F.coalesce(c, F.lit("")), 1, CLIP).alias(name) for c, name in (("predicted_output", "predicted"), ("expected_output", "reference"))]
    details = F.to_json(F.struct(*clips, F.struct(*made).alias("rouge_details"), status.alias("criteria_met")))
    return _scored(read, success, F.col("_composite"), details, F.col("_metrics")).select(*df.columns, *SCORED)
