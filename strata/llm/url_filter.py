"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary, a table (term, weight) or a mapping, is matched by one Aho-Corasick
automaton over the whole url, A-Z lower-cased: host, path, query and fragment, with or
without a scheme. A hit counts where letters and digits do not continue on either side. A
term of weight STRICT or more is strict, any other soft. One strict term, or `soft_needed`
different soft terms that together weigh `weight_needed`, block the url.

Defined cases: a null url has no rule, no hit and the verdict allow; host and path of a url
without `://` are empty, its terms count; a null or empty term is no term; repeated rows
are judged alike; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# host/path prefix -> verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
# Term -> weight in hundredths.
STRICT = 100
VOCABULARY = {
    "casino": 100, "porn": 100, "porno": 100, "xxx": 100, "viagra": 100, "cialis": 100, "malware": 100, "warez": 100, "keygen": 100, "escort": 100,
    "ads": 40, "adult": 60, "banner": 30, "bet": 40, "bets": 50, "betting": 60, "bingo": 50, "bonus": 40, "cheap": 40, "click": 30,
    "coupon": 30, "crack": 60, "cracked": 60, "deal": 30, "deals": 30, "download": 20, "farm": 30, "forex": 50, "free": 30, "gambling": 70,
    "jackpot": 60, "loan": 40, "loans": 50, "lottery": 60, "mp3": 30, "nude": 70, "offer": 30, "payday": 60, "pharmacy": 60, "pill": 50,
    "pills": 60, "poker": 60, "popup": 40, "promo": 30, "replica": 50, "serial": 40, "sex": 70, "slots": 60, "spam": 60, "torrent": 50,
    "track": 30, "tracker": 40, "win": 30, "winner": 40,
}
SOFT_NEEDED = 2
WEIGHT_NEEDED = 100
MAX_TERMS = 2_000_000


def terms_of(vocabulary: dict[str, int] | DataFrame) -> dict[str, int]:
    """The vocabulary as a mapping; a table of more than MAX_TERMS terms is refused, as it is sent to every worker."""
    if isinstance(vocabulary, DataFrame):
        rows = vocabulary.groupBy(F.col("term").cast("string").alias("term")).agg(F.max("weight").cast("long").alias("weight")).limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValueError(f"a vocabulary has {MAX_TERMS} terms at most")
        vocabulary = {r.term: r.weight for r in rows if r.weight is not None}
    return {term.translate(_LOWER): weight for term, weight in vocabulary.items() if term}


_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton(strict: dict[str, int], soft: dict[str, int]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, terms in ((True, strict), (False, soft)):
        for term, weight in terms.items():
            out.add_word(term, (term, kind, weight))
    out.make_automaton()
    return out


def hits(auto, text: str) -> dict[str, tuple[bool, int, int]]:
    """Terms that stand alone in text: term -> (strict, weight, count)."""
    found: dict[str, tuple[bool, int, int]] = {}
    if not len(auto):
        return found
    for end, (term, strict, weight) in auto.iter(text):
        start = end - len(term)
        if (start < 0 or not text[start].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            found[term] = (strict, weight, found.get(term, (0, 0, 0))[2] + 1)
    return found


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, vocabulary: dict[str, int] | DataFrame = VOCABULARY, soft_needed: int = SOFT_NEEDED, weight_needed: int = WEIGHT_NEEDED) -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_hits (different terms) and soft_weight, for each row of df."""
    terms = terms_of(vocabulary)
    rest = F.expr("CASE WHEN locate('://', __url) > 0 THEN substring(__url, locate('://', __url) + 3) ELSE '' END")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = (
        df.select(F.col(id_col), F.col(url_col).alias("__url"))
        .withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), upper, lower))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .select(id_col, "host", "path", "__url")
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key in sorted(rules, key=lambda k: (len(k), k)):  # the longest is tried first, as it is put outermost last
        host, _, path = key.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, key).otherwise(rule), F.when(fits, rules[key]).otherwise(verdict)
    ruled = parts.withColumn("rule", rule).withColumn("__by_rule", verdict)

    def count(batches):
        auto = automaton({t: w for t, w in terms.items() if w >= STRICT}, {t: w for t, w in terms.items() if w < STRICT})
        for batch in batches:
            found = [[(s, w) for s, w, _ in hits(auto, (url or "").translate(_LOWER)).values()] for url in batch.column("__url").to_pylist()]
            columns = (
                [sum(s for s, _ in ws) for ws in found],
                [sum(not s for s, _ in ws) for ws in found],
                [sum(w for s, w in ws if not s) for ws in found],
            )
            out = batch.drop_columns(["__url"])
            for name, column in zip(("strict_hits", "soft_hits", "soft_weight"), columns):
                out = out.append_column(name, pa.array(column, pa.int64()))
            yield out

    kept = [f for f in ruled.schema if f.name != "__url"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", strict_hits long, soft_hits long, soft_weight long"
    counted = ruled.mapInArrow(count, schema)
    bad = (F.col("strict_hits") > 0) | ((F.col("soft_hits") >= soft_needed) & (F.col("soft_weight") >= weight_needed))
    verdict = F.coalesce("__by_rule", F.when(bad, "block").otherwise("allow"))
    return counted.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "strict_hits", "soft_hits", "soft_weight")
