"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gets counts by plain rules and two histograms: of its characters by
class, and of its words over the common words of its language. The language
references are the summed histograms of all documents of that language that
pass the plain rules and are long enough. A text is rejected by the plain rules,
or if it is long enough and its Jensen-Shannon distance (base 2, 0 to 1) from the
reference of its language is too large for either histogram.

Defined cases: a null text has no words (and fails the plain rules, as any text
of under ten words does). A null or unlisted lang shares the reference "other",
with no common words. Where a language has no document to make a reference of,
nothing is rejected for divergence. Repeated rows are judged each on their own.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A document needs so many words for its character classes to be judged or to count for the reference.
MIN_WORDS = 50
#: A document needs so many words for its common words to be judged: short ones stray further by chance.
MIN_COMMON = 100
#: The largest distances that are kept: characters by class, common words.
MAX_CLASSES, MAX_COMMON = 0.30, 0.24

# Common words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que"],
}
# Character classes; the rest of the characters are one more class, and white space another.
CLASSES = {"upper": "[A-ZÀ-ÖØ-Þ]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "stop": "[.,;:!?]"}

SPACE = " \t\n\x0b\f\r"
_SPACES = "[\\x20\\x09-\\x0D]+"


def _count(text: Column, pattern: str) -> Column:
    """How many single characters of the text match."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: the plain counts and both histograms.

    Windows of five words are compared by a 64-bit hash. All steps stay inside a
    row, so a long or frequent text needs no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim("text", F.lit(SPACE))
    lang = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("other")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("ref"))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACES, -1)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.withColumn("lines", lines)
    # windows of five words
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - 4, F.lit(0)))
    rows = rows.withColumn("windows", F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, 5)))))
    # only where one occurs again: (window, place) in order, so that equal ones are neighbours
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("ordered", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda x, k: F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))
    twice = F.transform("ordered", lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"]))
    rows = rows.withColumn("places", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    # each place adds the words up to the next place, five at most
    added = F.transform("places", lambda i, k: F.least(F.lit(5), F.coalesce(F.get("places", k + 1) - i, F.lit(5))))
    common = F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = rows.withColumn("listed", F.coalesce(common[F.col("ref")], F.array().cast("array<string>")))
    classes = [_count(F.col("text"), p) for p in CLASSES.values()]
    rows = rows.select(
        "doc_id",
        "ref",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*classes).alias("found"),
        "listed",
        F.filter("words", lambda w: F.array_contains("listed", w)).alias("hits"),
    )
    symbols = F.col("found")[list(CLASSES).index("symbol")]
    hits = F.transform("listed", lambda c: F.size(F.filter("hits", lambda x: x == c)).cast("long"))
    return rows.select(
        "doc_id",
        "ref",
        "n_words",
        "word_chars",
        symbols.alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.concat("found", F.array(F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x))).alias("classes"),
        F.concat(hits, F.array(F.col("n_words") - F.size("hits"))).alias("common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts of one length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, c: a + c)
    share = lambda x: F.transform(x, lambda c: c / total(x))
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    each = F.zip_with(share(p), share(q), lambda a, b: term(a, (a + b) / 2) / 2 + term(b, (a + b) / 2) / 2)
    return F.sqrt(F.greatest(total(each), F.lit(0.0)))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, min_common: int = MIN_COMMON, max_classes: float = MAX_CLASSES, max_common: float = MAX_COMMON) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: the plain counts, base_failed and kept."""
    found = written(counts(docs), "quality-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = found.withColumn("base_failed", failed)
    # one row for each listed language and "other": len(COMMON) + 1 rows, whatever the input
    sums = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n)))
    bins = max(map(len, COMMON.values())) + 1
    good = judged.filter(~F.col("base_failed") & (F.col("n_words") >= min_words))
    refs = good.groupBy("ref").agg(sums("classes", len(CLASSES) + 2).alias("ref_classes"), F.filter(sums("common", bins), lambda x: x.isNotNull()).alias("ref_common"))
    both = judged.join(F.broadcast(refs), "ref", "left")
    odd = (F.col("n_words") >= min_words) & (distance(F.col("classes"), F.col("ref_classes")) > max_classes)
    foreign = (F.col("n_words") >= min_common) & (distance(F.col("common"), F.col("ref_common")) > max_common)
    rejected = F.col("base_failed") | F.coalesce(odd, F.lit(False)) | F.coalesce(foreign, F.lit(False))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~rejected).alias("kept"))


def sql(min_words: int = MIN_WORDS, min_common: int = MIN_COMMON, max_classes: float = MAX_CLASSES, max_common: float = MAX_COMMON) -> str:
    """The same for DuckDB over ``documents``."""
    listed = " ".join(f"when '{k}' then {v}" for k, v in COMMON.items())
    class_counts = ", ".join(f"len(regexp_extract_all(t, '{p}'))::bigint" for p in CLASSES.values())
    symbol = list(CLASSES).index("symbol") + 1
    spaces = "[\\x20\\x09-\\x0D]"

    def dist(p: str, q: str) -> str:
        share = lambda x: f"list_transform({x}, lambda c: c::double / list_sum({x}))"
        term = lambda a: f"(case when {a} > 0 then {a} * log2({a} / ((z[1] + z[2]) / 2)) else 0 end) / 2"
        return f"sqrt(greatest(list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: {term('z[1]')} + {term('z[2]')})), 0))"

    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, case when lang in ({', '.join(f"'{k}'" for k in COMMON)}) then lang else 'other' end ref from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{spaces}+'), lambda x: x <> '') words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines, case ref {listed} else [] end listed from d),
pos as (select r, unnest(range(1, len(words) - 3)) i, words from w where len(words) > 4),
win as (select r, i, array_to_string(words[i:i+4], ' ') g from pos),
dup as (select r, i from win qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct i + k) n from dup, (select unnest(range(5)) k) group by r),
c as (select w.r, doc_id, ref, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars, length(t)::bigint n_chars, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, [{class_counts}] found, list_concat(list_transform(listed, lambda c: len(list_filter(words, lambda x: x = c))::bigint), [(len(words) - len(list_filter(words, lambda x: list_contains(listed, x))))::bigint]) common from w left join rep using (r)),
f as (select *, found[{symbol}] n_symbols, list_concat(found, [n_chars - word_chars, (word_chars - list_sum(found))::bigint]) classes, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from c),
s as (select ref, k, sum(v) v from (select ref, unnest(classes) v, unnest(range(len(classes))) k from f where not base_failed and n_words >= {min_words}) group by all),
u as (select ref, k, sum(v) v from (select ref, unnest(common) v, unnest(range(len(common))) k from f where not base_failed and n_words >= {min_words}) group by all),
refs as (select * from (select ref, list(v order by k) ref_classes from s group by ref) join (select ref, list(v order by k) ref_common from u group by ref) using (ref))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or coalesce(n_words >= {min_words} and {dist('classes', 'ref_classes')} > {max_classes}, false) or coalesce(n_words >= {min_common} and {dist('common', 'ref_common')} > {max_common}, false)) kept
from f left join refs using (ref)"""
