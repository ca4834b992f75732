"""Spelling variants: words one edit apart, found through a reduced alphabet, and the form that each is a variant of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, removed, staged

#: Letters of a word, besides A-Z, which are lower-cased: fixed by the definition of a run.
LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
RUN = "[A-Za-zÀ-ÿ]"
#: A text is read in blocks of so many characters, each prolonged to the end of its last run, so no task holds all runs of a long text.
BLOCK = 1 << 16


def occurrences(docs: DataFrame, shortest: int, doc_id: str = "doc_id", text: str = "text", every: int = 31) -> DataFrame:
    """word: a row for each run of letters with at least `shortest` code points.

    Of the runs whose crc32 with the document's id (null: empty) is a multiple of `every`, one code point is dropped first.
    """
    blocks = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}{RUN}*"), F.lit(0))).alias("block"))
    runs = blocks.select("id", F.explode(F.regexp_extract_all("block", F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), "id")
    h, at = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.col("at").cast("int")
    runs = runs.withColumn("h", h).withColumn("at", F.col("h") % F.length("run"))
    dropped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, dropped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, n) of the words that occur at least `least` times; counted in each task before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def symbols_for(n_words: int) -> int:
    """Symbols of the reduced alphabet: the fewest (4 at least) whose strings of eight outnumber the words."""
    k = 4
    while k < 26 and k**8 < n_words:
        k += 1
    return k


def reduced(word: Column, symbols: int) -> Column:
    """word with each letter hashed to one of a few symbols: its code point modulo their number."""
    return F.translate(word, "".join(LETTERS), "".join(chr(ord("a") + ord(c) % symbols) for c in LETTERS))


def neighbourhood(r: Column, symbols: int, shortest: int) -> Column:
    """Hashes of the one-edit neighbours of a reduced word, and of itself.

    Each pair of neighbours is made from one of its two ends: replacements by a later symbol here, by an earlier one at the
    partner; deletions here, the insertion that undoes one at the partner, whose own reduced word it leads to.
    """
    head, tail = lambda i: F.substr(r, F.lit(1), i - 1), lambda i: F.substr(r, i + 1, F.length(r))
    places = F.sequence(F.lit(1), F.length(r))
    later = lambda i: F.filter(F.array(*[F.lit(chr(ord("a") + s)) for s in range(symbols)]), lambda s: s > F.substr(r, i, F.lit(1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(later(i), lambda s: F.concat(head(i), s, tail(i)))))
    deleted = F.when(F.length(r) > shortest, F.transform(places, lambda i: F.concat(head(i), tail(i)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.array(r), replaced, deleted), lambda x: F.xxhash64(x)))


def near_pairs(vocab: DataFrame, symbols: int, shortest: int) -> DataFrame:
    """(u, u_n, v, v_n) for each unordered pair of words that differ by exactly one edit, once."""
    each = vocab.withColumn("r", reduced(F.col("word"), symbols))
    made = each.select(F.col("word").alias("u"), F.col("n").alias("u_n"), F.explode(neighbourhood(F.col("r"), symbols, shortest)).alias("key"))
    own = each.select(F.col("word").alias("v"), F.col("n").alias("v_n"), F.xxhash64("r").alias("key"))
    ru, rv = reduced(F.col("u"), symbols), reduced(F.col("v"), symbols)
    from_here = (F.length("u") == F.length("v") + 1) | ((F.length("u") == F.length("v")) & ((ru < rv) | ((ru == rv) & (F.col("u") < F.col("v")))))
    return made.join(own, "key").where(from_here & (F.levenshtein("u", "v", 1) == 1)).select("u", "u_n", "v", "v_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far in each round.

    A form is ten times as frequent as its word, so no chain is longer than the digits of the largest count, and there is no cycle.
    """
    now = staged(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = staged(now.join(further, now["root"] == further["_at"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "forms")
        removed(now)
        now = step
        if step.where("moved").isEmpty():
            return step.drop("moved")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, doc_id: str = "doc_id", text: str = "text", symbols: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of the vocabulary.

    Words are near if exactly one code point is inserted, deleted or replaced. A word's form is its near word of the
    largest n (ties: smallest in code-point order) if that n is at least `times` its own, else null; root follows forms to
    the last and is the word itself where it has none. Null and empty texts have no words, a null id counts as an empty
    one, repeated rows count again, and an empty table gives no rows; other columns of docs aren't read. A word has no more
    near words than its alphabet allows, so no key of what follows the vocabulary grows with the corpus.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that chains of forms end")
    vocab = staged(vocabulary(occurrences(docs, shortest, doc_id, text), least), "vocabulary")
    pairs = near_pairs(vocab, symbols or symbols_for(vocab.count()), shortest)
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n")).alias("minus"), F.col(b).alias("form")).alias("near")) for a, b in ("uv", "vu")]))
    best = pairs.select(sides.alias("x")).groupBy("x.word").agg(F.count("*").alias("n_near"), F.min("x.near").alias("near"))
    found = vocab.join(best, "word", "left")
    has = -F.col("near.minus") >= times * F.col("n")
    found = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near.form")).alias("form"), F.when(has, -F.col("near.minus")).alias("form_n")), "near")
    removed(vocab)
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
