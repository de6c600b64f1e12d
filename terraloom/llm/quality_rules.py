"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every metric is an expression over one row, so the operator has no shuffle, no Python worker and no state; rows of any
size stay where they are read. Ratios divide by at least one.

Defined cases: a null or blank text has no words and fails ``min_words``; repeated rows are judged one by one and alike;
an empty table gives an empty table; other columns of the input are not touched, whatever their names (all working
columns live in a struct-free narrow projection of the two columns named by the caller).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import BLANKS, WORD, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which with "
    "au aux avec dans de des du elle en est et il la le les leur ne pas par pour qui que se sur un une "
    "auf das dem den der des die ein eine er es für ist mit nicht sich sie und von zu "
    "al como con del el ella en es ha las lo los más no para por se su una y"
).split()

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the metric's value must lie within [low, high]; a missing bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def failed(self, value: Column) -> Column:
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < F.lit(self.low))
        if self.high is not None:
            bad = bad | (value > F.lit(self.high))
        return bad


#: The base rules; all other rules are the method's own verdict.
BASE = (
    Rule("min_words", "n_words", low=20),
    Rule("repeated_windows", "repeat_share", high=0.30),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("repeated_lines", "dup_line_share", high=0.60),
    Rule("stop_words", "stop_share", low=0.01),
    Rule("stuttering", "stutter_share", high=0.30),
)


def _windows(n: Column, w: Column, make) -> Column:
    """make(window, its first position) for each window of WINDOW words."""
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), (n - (WINDOW - 1)).cast("int")), lambda i: make(F.slice(w, i, WINDOW), i)))


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the counts that the rules read; ``carry`` names columns of docs to pass through."""
    kept = [id_col, *carry]
    text = F.coalesce(F.col("__text"), F.lit(""))
    step = docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("__text"))
    step = step.select(
        *kept,
        words(F.col("__text")).alias("__w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    w, n = F.col("__w"), F.size("__w")
    step = step.select(
        *kept,
        "__w",
        "word_chars",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(n, F.lit(1))).alias("b")), lambda p: p["a"] == p["b"])).cast("long").alias("n_stutter"),
        _windows(n, w, lambda x, i: F.xxhash64(x)).alias("__h"),
    )
    narrow = [*kept, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop", "n_stutter"]
    # Equal windows have equal hashes, so only texts with an equal pair of hashes are looked at window by window.
    step = step.select(
        *narrow,
        F.when(
            F.size(F.array_distinct("__h")) < F.size("__h"),
            F.sort_array(_windows(n, w, lambda x, i: F.struct(F.array_join(x, " ").alias("w"), i.alias("p")))),
        ).alias("__s"),
    )
    s = F.col("__s")
    step = step.select(
        *narrow,
        F.sort_array(
            F.array_compact(F.transform(s, lambda x, j: F.when((F.get(s, j + 1)["w"] == x["w"]) | (F.get(s, F.when(j > 0, j - 1))["w"] == x["w"]), x["p"])))
        ).alias("__p"),
    )
    p = F.col("__p")
    covered = F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return step.select(*narrow, F.when(F.size(p) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def _ratios() -> dict[str, Column]:
    per_word, per_line = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_share": F.col("n_repeat_words") / per_word,
        "mean_word_chars": F.col("word_chars") / per_word,
        "symbol_ratio": F.col("n_symbols") / per_word,
        "dup_line_share": F.col("n_dup_lines") / per_line,
        "stop_share": F.col("n_stop") / per_word,
        "stutter_share": F.col("n_stutter") / per_word,
    }


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and the names of the failed rules to the output of metrics()."""
    value = _ratios()
    # Whole numbers decide the base rules, so that no rounding of a ratio can tip them.
    base = (F.col("n_words") < BASE[0].low) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(r.failed(value[r.metric]), F.lit(r.name)) for r in (*BASE, *rules)]))
    own = [r.failed(value[r.metric]) for r in rules]
    verdict = ~base
    for bad in own:
        verdict = verdict & ~bad
    return measured.withColumns({"base_failed": base, "kept": verdict, "failed_rules": failed})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics and verdict of every document."""
    return judge(metrics(docs, id_col, text_col), rules)


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that pass; still one projection, without a join.

    Rows that fail leave by an empty explode: a filter would be pushed below the projections and compute the metrics again for
    every mention of them in it.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = whole.select("__row", F.col(f"__row.{id_col}").alias("__id"), F.col(f"__row.{text_col}").alias("__body"))
    judged = judge(metrics(keyed, "__id", "__body", ("__row",)), rules)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")
