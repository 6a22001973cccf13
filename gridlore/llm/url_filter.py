"""URL filter: listed host and path rules, and a weighted vocabulary for every URL that no rule fits.

The vocabulary is an Aho-Corasick automaton over the lower-cased URL. A term counts where neither neighbour is an ASCII
letter or digit. One strict term, or ``SOFT_HITS`` different soft terms, reject the URL. The automaton has as many nodes
as the vocabulary has letters, so its size does not depend on the table; each task builds it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# (verdict, host, path) of the listed rules
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# own vocabulary, which a file or table can replace (``vocabulary``): one of these rejects a URL
STRICT = (
    "adult", "bestiality", "bordello", "brothel", "casino", "camgirl", "camsex", "erotic", "erotica", "escort", "fetish", "gambling", "hardcore",
    "hentai", "hookup", "incest", "malware", "milf", "nude", "nudity", "orgy", "phishing", "porn", "porno", "pornography", "prostitute", "ransomware",
    "roulette", "sex", "sexcam", "spam", "spyware", "sportsbook", "stripper", "swinger", "trojan", "viagra", "cialis", "voyeur", "warez", "xxx",
)
# ... and so do two different ones of these
SOFT = (
    "ad", "advert", "affiliate", "baccarat", "bargain", "bet", "bingo", "blackjack", "bonus", "botnet", "cashback", "cheap", "cheat", "clickbait",
    "click", "coupon", "crack", "cracked", "dating", "deal", "diet", "discount", "download", "drug", "exploit", "farm", "free", "freebie", "gamble",
    "giveaway", "hack", "jackpot", "keygen", "lender", "loan", "lottery", "lotto", "mortgage", "offer", "payday", "pharmacy", "pill", "pirate", "poker",
    "popup", "prize", "promo", "promotion", "proxy", "replica", "rich", "seduce", "serial", "sexy", "singles", "slot", "spin", "steroid",
    "supplement", "sweepstake", "torrent", "track", "tracker", "unlock", "unlocked", "wager", "weightloss", "win", "winner",
)
SOFT_HITS = 2
MAX_TERMS = 1_000_000  # of a vocabulary, whose automaton every task builds


def forms(term: str) -> tuple[str, ...]:
    """A term and its regular inflections: plural, -ed and -ing."""
    vowels = "aeiou"
    out = [term, term + "es" if term.endswith(("s", "x", "z", "ch", "sh")) else term + "s"]
    stem = term
    if len(term) > 2 and term[-1] == "y" and term[-2] not in vowels:
        out.append(term[:-1] + "ies")
    if term.endswith("e"):
        stem = term[:-1]
    elif len(term) == 3 and term[0] not in vowels and term[1] in vowels and term[2] not in vowels + "wxy":
        stem = term + term[-1]
    return tuple(dict.fromkeys([*out, stem + "ed", stem + "ing"]))


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table terms(term, strict boolean), at most ``MAX_TERMS``; for ``judge``.

    Terms are lower-cased; a term with both weights is strict; rows without term or weight are left out.
    """
    rows = terms.selectExpr("lower(trim(term)) AS term", "strict").where("term <> '' AND strict IS NOT NULL")
    rows = rows.groupBy("term").agg(F.max("strict").alias("strict")).orderBy("term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    return tuple(r.term for r in rows if r.strict), tuple(r.term for r in rows if not r.strict)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(longest):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def term_hits(rows: DataFrame, strict=STRICT, soft=SOFT) -> DataFrame:
    """Adds strict_hits and soft_hits, the numbers of different terms in the column ``_url``; null counts as empty.

    A term counts in any of its forms, once; a form that two terms share counts for the strict one, or else the first.
    """
    kinds = {**dict.fromkeys(soft, 1), **dict.fromkeys(strict, 0)}
    of: dict[str, str] = {}
    for term in (*strict, *soft):
        for form in forms(term):
            of.setdefault(form, term)
    schema = T.StructType([*rows.schema, *(T.StructField(c, T.IntegerType()) for c in ("strict_hits", "soft_hits"))])

    def bounded(text: str, start: int, end: int) -> bool:
        before, after = text[start - 1 : start], text[end : end + 1]
        return not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for form, term in of.items():
            automaton.add_word(form, (form, term))
        automaton.make_automaton()
        for b in batches:
            counts: tuple[list[int], list[int]] = ([], [])
            for url in b.column("_url").to_pylist():
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
                found = {t for end, (f, t) in automaton.iter(text) if bounded(text, end - len(f) + 1, end + 1)}
                for k in (0, 1):
                    counts[k].append(sum(kinds[t] == k for t in found))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(counts[0], pa.int32()), pa.array(counts[1], pa.int32())],
                [*b.schema.names, "strict_hits", "soft_hits"],
            )

    return rows.mapInArrow(run, schema)


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits: one row for every row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path; no rule fits it. URLs of any length are read whole, and repeated
    rows are judged each for itself. An empty table gives an empty result. Other columns are not read.
    """
    hits = term_hits(pages.select("page_id", F.col("url").alias("_url")), strict, soft)
    parts = hits.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rejected = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits)
    own = F.when(rejected, "block").otherwise("allow")
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits"
    )
