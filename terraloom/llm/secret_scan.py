"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Base kinds are always reported. Further candidates (well-known token shapes and long quoted strings of mixed letters and
digits) are reported only if the corpus says that they look live: each candidate's hash is counted by distinct owners and
repositories; a value that many owners share, or that stands in many repositories of few owners, is an example that people copy; a value that stays with
few owners and few repositories is a credential. Copies of a text within an owner count as one repository.
The same verdict splits the base spans into live ones and examples.

Texts are read once; what is shuffled is (hash, owner, repository), pre-aggregated before it is dealt out, and spans of the
documents that have any. Owner is the document's source and repository the document itself unless the caller names others.

Defined cases: a null text has no spans; null owners and repositories count as one each; rows that repeat id, text
and owner give the same spans each and count once; an empty table gives an empty table; other columns are ignored by scan() and
kept by redacted().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import attach, written
from terraloom.llm.spans import Kind, counted, find, listed, replaced

_long = lambda n: lambda v: F.length(v) >= n

BASE = (
    Kind("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, _long(6)),
    Kind("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 0, _long(20)),
    Kind("hex", r"[0-9a-f]{24}", r"(?:(?<![0-9a-f])|\G)[0-9a-f]{24,}+", 0, _long(24)),
)
_mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
#: Published shapes of access tokens of common services, and any long quoted string.
EXTRA = (
    Kind("service", r"ghp_|xox[abpr]-|AIza|sk_live_|eyJ", r"(?<![A-Za-z0-9_])(?:ghp_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)", 0, _mixed),
    Kind("quoted", r"""["'][A-Za-z0-9+/_=-]{20}""", r"""(?<=["'])[A-Za-z0-9+/_=-]{20,}+(?=["'])""", 0, _mixed),
)


def _key(id_col: str, text_col: str, owner_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col), F.length(F.col(text_col))).alias("__h"), F.col(owner_col).alias("__owner")]


KEY = ["__id", "__h", "__owner"]


def _judged(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None, max_owners: int, max_repos: int) -> tuple[DataFrame, DataFrame]:
    """All rows (key, base spans), and for keys that have candidates all spans to report with ``live``."""
    rows = docs.select(*_key(id_col, text_col, owner_col), F.col(repo_col or id_col).cast("string").alias("__repo"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = find(find(rows, "__text", BASE, "__base"), "__text", EXTRA, "__extra", len(BASE))
    # An extra candidate inside a base span is the same secret.
    apart = F.filter("__extra", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    found = written(found.select("__id", "__h", "__owner", "__repo", "__base", apart.alias("__extra")), "secrets")
    some = found.where((F.size("__base") > 0) | (F.size("__extra") > 0))
    # Copies of one text within an owner count as one repository, the least.
    some = some.groupBy("__id", "__h", "__owner").agg(F.min("__repo").alias("__repo"), F.first("__base").alias("__base"), F.first("__extra").alias("__extra"))
    each = some.select("__id", "__h", "__owner", "__repo", F.explode(F.concat("__base", "__extra")).alias("s")).withColumn("v", F.sha2("s.value", 256))
    by_text = each.groupBy("v", "__owner", "__h").agg(F.min("__repo").alias("__repo"), F.count("*").alias("n"))
    by_repo = by_text.groupBy("v", "__owner", "__repo").agg(F.sum("n").alias("n"))
    by_owner = by_repo.groupBy("v", "__owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    spread = by_owner.groupBy("v").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = each.join(spread, "v").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    judged = judged.where(F.col("live") | (F.col("s.rank") < len(BASE)))
    span = F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value", "live", "owners", "repos")
    return found, judged.groupBy("__id", "__h", "__owner").agg(F.sort_array(F.collect_list(span)).alias("__spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 2, max_repos: int = 10) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans, and how many look live or copied."""
    rows, judged = _judged(docs, id_col, text_col, owner_col, repo_col, max_owners, max_repos)
    out = attach(rows.select(*KEY, "__base"), judged, KEY)
    base, spans = F.col("__base"), F.col("__spans")
    some = lambda live: F.coalesce(F.size(F.filter(spans, lambda s: s["live"] == live)), F.lit(0)).cast("long")
    return out.select(
        F.col("__id").alias(id_col),
        *[counted(base, k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        F.coalesce(listed(spans), F.lit("")).alias("spans"),
        F.when(spans.isNull(), 0).otherwise(some(True)).cast("long").alias("n_live"),
        F.when(spans.isNull(), 0).otherwise(some(False)).cast("long").alias("n_example"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 2, max_repos: int = 10, length_col: str | None = None) -> DataFrame:
    """docs with every reported span masked: live ones as [SECRET], widely copied ones as [EXAMPLE]; length_col follows the text."""
    _, judged = _judged(docs, id_col, text_col, owner_col, repo_col, max_owners, max_repos)
    whole = docs.select(*_key(id_col, text_col, owner_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    out = attach(whole, judged, KEY)
    label = lambda s: F.when(s["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))
    body = F.col(f"__row.{text_col}")
    masked = out.select("__row", F.when(F.col("__spans").isNull(), body).otherwise(replaced(body, F.col("__spans"), label)).alias("__body"))
    new = {text_col: F.col("__body")} | ({length_col: F.length("__body").cast("long")} if length_col else {})
    return masked.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
