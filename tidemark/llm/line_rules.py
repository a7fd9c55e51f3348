"""Quality rules: lines that many documents of a host share go, and documents depleted by that go too.

Lines are lower-cased, white space is collapsed, and the result is hashed. For each host and line the
distinct documents are counted; copies of a whole text count once, so a document is not rejected for
having been copied. Lines above the limit are boilerplate: they are removed from all documents but the
first that holds them, and a document that keeps less than ``least_kept`` of its words is rejected.
``without_frequent`` returns the texts without these lines, from the same places that ``quality_rules`` counts.
The limit is a number of texts, or with ``share`` that share of a host's distinct texts and ``LEAST_TEXTS`` at least.

A document hands on each of its lines once, and counts are added up before the shuffle, so a line in a
third of all documents is a number per task. The join back spreads each frequent line over ``SALTS``.

Defined cases: a null text has no words and fails the base rule; a null host is a host of its own;
lines without words are never counted; documents are told apart by id and text, so repeated rows
get the same verdict; further columns are ignored. Base columns are exact for texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query
from .support import row_key, stage, table, text_of, unused

#: A line is boilerplate in a host when more than this many distinct texts hold it.
LIMIT = 100
#: With a limit as a share of the host's texts: a line in this many texts or fewer always stays.
LEAST_TEXTS = 5
#: The query's limit: a line in more than this share of a host's distinct texts is boilerplate, at every size.
SHARE = 0.02
#: Least share of a document's words that must stay.
LEAST_KEPT = 0.3
#: Rows that a frequent line is spread over in the join back.
SALTS = 32
# fixed values of the contract
WINDOW, REPEAT_SHARE, LEAST_WORDS, SYMBOLS = 5, 20, 10, "#*$%&|<>"
SPACE, WITH_WORDS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<long>"))


def with_repeats(df: DataFrame) -> DataFrame:
    """Turn ``hashes`` of five-word windows into n_repeat_words, the words in windows found twice or more.

    Only a text whose hashes are not all distinct sorts them with their places. Equal neighbours are
    repeats, and their places, in order, cover min(5, gap to the next) words each.
    """
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    paired = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    one = df.withColumn("pairs", F.when(twice, F.sort_array(paired)))
    n = F.size("pairs")
    at = lambda i: F.get("pairs", i)["h"]
    spots = F.sort_array(F.transform(
        F.filter(F.transform("pairs", lambda p, i: F.struct(p["i"].alias("i"), ((p["h"] == at(i - 1)) | (p["h"] == at(i + 1))).alias("again"))), lambda x: F.coalesce(x["again"], F.lit(False))),
        lambda x: x["i"],
    ))
    two = one.withColumn("spots", F.when(n > 0, spots))
    gap = F.transform("spots", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get("spots", i + 1) - s, F.lit(WINDOW))))
    total = F.aggregate(gap, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return two.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("pairs", "spots", "hashes")


def lines_in(text: Column) -> Column:
    """The lines of a text that have words."""
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WITH_WORDS)))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal(line))


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def base_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base columns of each document and its lines as (hash, words), each once."""
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long"), F.col(host).alias("host"), row_key().alias("key"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("lines", lines_in(F.col("text")))
    size = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
    marked = F.transform(F.transform("lines", normal), lambda line: F.struct(F.xxhash64(line).alias("h"), size(line).cast("long").alias("n")))
    found = rows.select(
        "doc_id", "host", "key", F.xxhash64("text").alias("content"), F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        marked.alias("marked"), window_hashes(F.col("words")).alias("hashes"),
    )
    return with_repeats(found).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    )


def frequent_lines(lines: DataFrame, limit: int, share: float | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Lines (host, h) in more than ``limit`` distinct texts of a host, with the first document that holds each.

    ``lines`` has a row per distinct text, host and line, so a plain count that combines before the
    shuffle counts distinct texts. With ``share`` the limit is that share of the host's rows in ``texts``.
    """
    counted = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first"))
    if share is None:
        return counted.filter(F.col("n_docs") > limit)
    hosts = texts.groupBy(F.col("host").alias("its_host")).agg(F.greatest(F.lit(float(LEAST_TEXTS)), F.lit(share) * F.count(F.lit(1))).alias("most"))
    return counted.join(hosts, F.col("host").eqNullSafe(F.col("its_host"))).filter(F.col("n_docs") > F.col("most")).drop("its_host", "most")


def cut_lines(seen: DataFrame, limit: int, share: float | None) -> DataFrame:
    """Rows (cut_host, cut_key, cut, n_cut_words, n_cut_lines): the hashes of the lines that a document loses, and their counts."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    texts = seen.groupBy("host", "content").agg(F.min_by("marked", rank).alias("marked"), F.min(rank).alias("first"))
    distinct = texts.select("host", "first", F.explode(F.array_distinct(F.transform("marked", lambda m: m["h"]))).alias("h"))
    frequent = frequent_lines(distinct, limit, share, texts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    # all places of a line in a document count against it, so equal lines are added up, not dropped
    held = seen.dropDuplicates(["host", "key"]).select("host", "key", "doc_id", salt.alias("salt"), F.explode("marked").alias("m"))
    held = held.select("host", "key", "doc_id", "salt", "m.h", "m.n")
    same = (held["h"] == frequent["h"]) & (held["salt"] == frequent["salt"]) & held["host"].eqNullSafe(frequent["host"])
    cut = held.join(frequent, same).filter(held["key"] != frequent["first"]["key"])
    lost = cut.groupBy(held["host"], held["key"]).agg(
        F.collect_set(held["h"]).alias("cut"), F.sum(held["n"]).alias("n_cut_words"), F.count(F.lit(1)).alias("n_cut_lines")
    )
    return lost.withColumnsRenamed({"host": "cut_host", "key": "cut_key"})


def without_frequent(docs: DataFrame, host: str = "source", limit: int = LIMIT, share: float | None = None) -> DataFrame:
    """The documents without their frequent lines, all columns kept; ``n_chars`` follows the text where it exists.

    Every document stays; ``quality_rules`` says which ones are rejected.
    """
    key, its_host, its_key, cut = (unused(docs, c) for c in ("key", "cut_host", "cut_key", "cut"))
    lost = cut_lines(stage(base_rules(docs, host), "line-rules"), limit, share)
    lost = stage(lost.select(F.col("cut_host").alias(its_host), F.col("cut_key").alias(its_key), F.col("cut").alias(cut)), "cut-lines")
    keyed = docs.withColumn(key, row_key())
    joined = keyed.join(lost, (F.col(key) == F.col(its_key)) & F.col(host).eqNullSafe(F.col(its_host)), "left")
    stays = lambda line: ~F.rlike(line, F.lit(WITH_WORDS)) | ~F.array_contains(cut, line_hash(line))
    touched = F.col(cut).isNotNull()
    out = joined.withColumn("text", F.when(touched, F.array_join(F.filter(F.split(text_of(), "\n"), stays), "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(
    docs: DataFrame, host: str = "source", limit: int = LIMIT, least_kept: float = LEAST_KEPT, share: float | None = None
) -> DataFrame:
    seen = stage(base_rules(docs, host), "line-rules")
    lost = cut_lines(seen, limit, share).drop("cut")
    left = seen.join(lost, (seen["key"] == lost["cut_key"]) & seen["host"].eqNullSafe(lost["cut_host"]), "left")
    n_cut = F.coalesce("n_cut_words", F.lit(0))
    depleted = F.col("n_words") - n_cut < F.lit(least_kept) * F.col("n_words")
    return left.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), n_cut.alias("n_cut_words"), F.coalesce("n_cut_lines", F.lit(0)).alias("n_cut_lines"),
    )


_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
real AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM real GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM win),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM again, range(0, 5) r(k) GROUP BY doc_id),
texts AS (SELECT host, text, min(doc_id) AS first FROM d GROUP BY host, text),
hosts AS (SELECT host, greatest({float(LEAST_TEXTS)}, {SHARE} * count(*)) AS most FROM texts GROUP BY host),
freq AS (SELECT host, norm, min(first) AS first FROM (SELECT DISTINCT host, text, first, norm FROM real JOIN texts USING (host, text)) JOIN hosts USING (host) GROUP BY host, norm, most HAVING count(*) > most),
lost AS (SELECT r.doc_id, sum(len(string_split(r.norm, ' ')))::BIGINT AS n_cut_words, count(*) AS n_cut_lines FROM real r JOIN freq f ON r.host = f.host AND r.norm = f.norm AND r.doc_id <> f.first GROUP BY r.doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
    coalesce(n_cut_words, 0) AS n_cut_words, coalesce(n_cut_lines, 0) AS n_cut_lines
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - n_cut_words < {LEAST_KEPT} * n_words) AS kept, n_cut_words, n_cut_lines FROM b"""


@query("op8_line_rules", _SQL)
def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), share=SHARE)
