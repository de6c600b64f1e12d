"""Personal data: base patterns, and terms that give away the people behind them; DataFrame functions only.

Base spans (e-mail, IP, card, phone) are protected entities. The words near an entity are judged by information theory: how much
of the entity's information content a term reveals is its pointwise mutual information with the entity over the whole corpus,

    PMI(e, t) = log2(N * joint(e, t) / (df(e) * df(t)))        IC(e) = log2(N / df(e))

with frequencies over distinct texts, and joint(e, t) of whole texts: a term counts wherever it stands in a text that holds the entity. A term
whose PMI reaches ``generalise`` of IC(e) discloses it: it is generalised; from ``remove`` on it is removed; at all of its places in the texts that
hold the entity. A term needs ``support`` different surroundings, so that copies of one passage don't count as evidence: the other words within
``reach`` characters of the entity, and for a term that stands farther away also the two words on each side of it
(so that the outermost two words of a copied passage can pass as different).

Texts are read twice (patterns, then the frequencies of terms); words of texts with entities, as hashes and positions, are written once, and a count for
each term of a partition is shuffled. No group is gathered: all counts are sums with map-side combining.

Defined cases: a null text has no spans; rows that repeat a text give the same spans each and count as
one text; an empty table gives an empty table; other columns are ignored by scan() and kept by sanitised().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import WORD, attach, words, written
from terraloom.llm.spans import Kind, counted, find, listed, replaced


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.struct(F.substring(d, i, F.lit(1)).cast("int").alias("x"), (i % 2 == 0).alias("twice")))
    value = lambda p: F.when(p["twice"], F.when(p["x"] > 4, 2 * p["x"] - 9).otherwise(2 * p["x"])).otherwise(p["x"])
    total = F.aggregate(each, F.lit(0), lambda a, p: a + value(p))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


BASE = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0, lambda v: F.lit(True)),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0, _octets),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9]++(?:[\x20-][0-9]++)*+", 0, _luhn),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda v: F.length(_digits(v)).between(9, 15)),
)
#: Characters that are not part of a term at its ends.
EDGES = ".,;:!?()[]{}\"'*#$%&|<>«»¿¡"


def term(w: Column) -> Column:
    return F.btrim(F.lower(w), F.lit(EDGES))


def _entities(reach: int) -> Column:
    """Each entity of a text once, with the terms around each of its places."""
    near = lambda b: F.transform(F.filter("__words", lambda w: (w["start"] >= b["start"] - reach) & (w["end"] <= b["end"] + reach)), lambda w: w["t"])
    return F.transform("__base", lambda b: F.struct(F.xxhash64(b["kind"], F.lower(b["value"])).alias("e"), near(b).alias("near")))


def _words(found: DataFrame) -> DataFrame:
    """Adds ``__words``: the words of __text outside all base spans, as (start, end, hash of the term)."""
    out = find(found, "__text", (Kind("word", "", WORD, 0, lambda v: F.lit(True)),), "__all")
    apart = F.filter("__all", lambda w: (F.length(term(w["value"])) > 0) & ~F.exists("__base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return out.withColumn("__words", F.transform(apart, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.xxhash64(term(w["value"])).alias("t")))).drop("__all")


def _joint(some: DataFrame, support: int) -> DataFrame:
    """(e, t, joint): in how many texts entity and term stand together, of pairs with enough different surroundings."""
    # A pair can't have more surroundings than its entity has texts and places, so most entities leave here.
    seen = some.select("__h", F.explode("__es").alias("x")).select("__h", "x.e", F.xxhash64("x.near").alias("about")).distinct()
    asked = written(seen.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("e"), "entities")
    aside = lambda i: F.array(*[F.get(F.col("__words"), i + k)["t"] for k in (-2, -1, 1, 2)])
    placed = some.select("__w", "__es", F.sort_array(F.transform("__words", lambda w, i: F.struct(w["t"].alias("t"), i.alias("i"), F.xxhash64(aside(i)).alias("aside")))).alias("__ts"))
    placed = placed.select("__w", "__es", F.filter("__ts", lambda x, i: (i == 0) | (F.get(F.col("__ts"), F.greatest(i - 1, F.lit(0)))["t"] != x["t"])).alias("__ts"))
    # The places of an entity travel in the exploded struct: computed once for each entity, not once for each of its pairs.
    own = F.transform(F.array_distinct(F.transform("__es", lambda x: x["e"])), lambda e: F.struct(e.alias("e"), F.transform(F.filter("__es", lambda x: x["e"] == e), lambda x: x["near"]).alias("near")))
    each = placed.select("__w", "__ts", F.explode(own).alias("o")).select("__w", "__ts", "o.e", "o.near").join(asked, "e")
    # Outer: for an inner explode Spark infers a filter on the array and computes it anew for each of its own elements.
    each = each.select("e", "__w", "near", F.explode_outer("__ts").alias("x")).where(F.col("x").isNotNull())
    t = F.col("x.t")
    by = F.filter("near", lambda o: F.array_contains(o, t))
    close = F.transform(by, lambda o, i: F.struct(F.xxhash64(F.filter(o, lambda v: v != t)).alias("about"), F.when(i == 0, F.col("__w")).otherwise(0.0).alias("w")))
    far = F.array(F.struct(F.xxhash64(F.element_at("near", 1), F.col("x.aside")).alias("about"), F.col("__w").alias("w")))
    pairs = each.select("e", t.alias("t"), F.explode(F.when(F.size(by) > 0, close).otherwise(far)).alias("c"))
    sums = pairs.groupBy("e", "t", "c.about").agg(F.sum("c.w").alias("w")).groupBy("e", "t").agg(F.count("*").alias("contexts"), F.round(F.sum("w")).alias("joint"))
    return written(sums.where(F.col("contexts") >= support).select("e", "t", "joint"), "terms")


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col), F.length(F.col(text_col))).alias("__h")]


def _judged(docs: DataFrame, id_col: str, text_col: str, reach: int, support: int, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    """All rows (key, base spans), and the term spans of the keys that have any."""
    rows = docs.select(*_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = find(rows, "__text", BASE, "__base")
    found = _words(found.select("__id", "__h", "__base", F.when(F.size("__base") > 0, F.col("__text")).alias("__text")))
    found = found.select("__id", "__h", "__base", F.when(F.size("__base") > 0, F.col("__words")).alias("__words"))
    found = written(found.select("__id", "__h", "__base", "__words", F.when(F.size("__base") > 0, _entities(reach)).alias("__es")), "pii")
    texts = docs.select(_key(id_col, text_col)[1], F.col(text_col).alias("__text"))
    # A text counts once, so each of its copies counts as its share; most texts have none, and sums are rounded to whole texts.
    copies = written(texts.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1"), "copies")
    shared = lambda df: df.join(copies, "__h", "left").withColumn("__w", 1.0 / F.coalesce(F.col("__n"), F.lit(1))).drop("__n")
    some = shared(found.where(F.size("__base") > 0))
    held = shared(texts).select("__w", F.explode(F.array_distinct(F.transform(words(F.col("__text")), lambda w: F.xxhash64(term(w))))).alias("t"))
    count = found.count() - (copies.agg(F.sum(F.col("__n") - 1)).first()[0] or 0)
    some = some.select("__id", "__h", "__w", "__words", "__es")
    joint = _joint(some, support)
    df_e = some.select("__w", F.explode(F.array_distinct(F.transform("__es", lambda x: x["e"]))).alias("e")).groupBy("e").agg(F.round(F.sum("__w")).alias("df_e"))
    # Counted where the texts are read; a partition sends one row for each of its terms.
    df_t = held.groupBy("t").agg(F.round(F.sum("__w")).alias("df_t")).join(joint.select("t").distinct(), "t")
    n = F.lit(float(max(count, 1)))
    scored = joint.join(df_e, "e").join(df_t, "t").withColumns({"pmi": F.log2(n * F.col("joint") / (F.col("df_e") * F.col("df_t"))), "ic": F.log2(n / F.col("df_e"))})
    scored = scored.withColumn("share", F.when(F.col("ic") > 0, F.col("pmi") / F.col("ic")).otherwise(0.0)).where(F.col("share") >= generalise)
    told = some.select("__id", "__h", F.explode(F.array_distinct(F.transform("__es", lambda x: x["e"]))).alias("e")).join(scored.select("e", "t", "share"), "e").groupBy("__id", "__h", "t").agg(F.max("share").alias("share"))
    hits = attach(some.select("__id", "__h", F.explode("__words").alias("x")).select("__id", "__h", "x.*"), told, ["__id", "__h", "t"]).where("share IS NOT NULL").groupBy("__id", "__h", "start", "end").agg(F.max("share").alias("share"))
    span = F.struct("start", F.lit(len(BASE)).alias("rank"), "end", F.lit("term").alias("kind"), F.when(F.col("share") >= remove, F.lit("removed")).otherwise(F.lit("generalised")).alias("value"))
    return found, hits.groupBy("__id", "__h").agg(F.sort_array(F.collect_list(span)).alias("__terms"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 32, support: int = 2, generalise: float = 0.7, remove: float = 0.95) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, and all spans, disclosing terms last."""
    rows, terms = _judged(docs, id_col, text_col, reach, support, generalise, remove)
    out = attach(rows.select("__id", "__h", "__base"), terms, ["__id", "__h"])
    base, extra = F.col("__base"), F.col("__terms")
    by_kind = F.array_sort(base, lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["start"] - b["start"]))
    return out.select(
        F.col("__id").alias(id_col),
        *[counted(base, k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(listed(by_kind), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size(base) > 0, listed(by_kind)), listed(extra)).alias("spans"),
        F.when(extra.isNull(), 0).otherwise(F.size(extra)).cast("long").alias("n_term"),
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 32, support: int = 2, generalise: float = 0.7, remove: float = 0.95) -> DataFrame:
    """docs with base spans replaced by their kind, disclosing terms generalised to [TERM] or removed."""
    rows, terms = _judged(docs, id_col, text_col, reach, support, generalise, remove)
    spans = attach(rows.select("__id", "__h", "__base"), terms, ["__id", "__h"]).select("__id", "__h", F.sort_array(F.concat("__base", F.coalesce("__terms", F.array()))).alias("__spans")).dropDuplicates(["__id", "__h"])
    whole = docs.select(*_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    met = attach(whole, spans, ["__id", "__h"])
    label = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "removed", F.lit("")).otherwise(F.lit("[TERM]"))
    body = F.col(f"__row.{text_col}")
    out = met.select("__row", replaced(body, F.col("__spans"), label).alias("__body"))
    return out.select(*[F.col("__body").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
