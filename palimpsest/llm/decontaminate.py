"""Benchmark passages in training texts, by a distributed positional inverted index. DataFrame functions only.

The index holds postings: a row for each place of a term in a different text. Of a benchmark only the
terms it uses matter, and of those only the rare ones are looked up: each window of the benchmark is led by
its ``LEADS`` terms with the fewest places in the corpus (counted first). Their lists, moved back by the
terms' offsets in the window, are intersected from the rarest on; few places are left, and there the words
themselves are compared. Lists are never gathered in a task: a posting is a row, joined by term, or by
text and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fields_of, materialise, row_of, sized

#: A word before A-Z are lowered: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``. Single characters are one look into a
#: table to Java's expressions, where ranges of an excluding class are tested one by one.
WORD = "[^" + "".join(f"\\x{k:02X}" for k in range(128) if not chr(k).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window, and its terms whose lists are intersected.
WINDOW, LEADS = 10, 3
#: Copies of the smaller side of a join on a term, where it is too large to be sent to every executor.
SALTS = 32


def raw_words(text: Column) -> Column:
    """Words as they stand in the text; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def low(word: Column) -> Column:
    """A-Z lowered, and no other letter."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def mark_of(text: Column) -> Column:
    """128 bits that stand for a text: copies share their postings."""
    return F.unhex(F.md5(text.cast("binary")))


def _meet(many: DataFrame, few: DataFrame, term: str = "term") -> DataFrame:
    """An inner join on a term. ``few`` is sent to every executor if its size, summed first, allows it;
    otherwise frequent terms are spread over salts of it."""
    held = sized(few)
    if held is not few:
        return many.join(held, term)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [term, "salt"]).drop("salt")


def _places(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term``, ``mark``, ``pos`` for each place of a term in the rows of ``texts`` (``mark``, ``text``)."""
    words = texts.select("mark", F.posexplode(raw_words(F.col("text"))).alias("pos", "raw"))
    return _meet(words.select("mark", "pos", low(F.col("raw")).alias("term")), terms.select("term"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The index of ``text`` for ``terms`` (column ``term``, all different): ``term``, ``mark``, ``pos``.

    A row for each place of a term, counted from 0 in the words of its text; a text that stands in several
    rows has its postings once. Null texts have none.
    """
    return _places(texts.where("text is not null").select(mark_of(F.col("text")).alias("mark"), "text"), terms).distinct()


def _postings_of(texts: DataFrame, marks: DataFrame, terms: DataFrame) -> DataFrame:
    """The index of the texts that have one of ``marks``; each is read once."""
    bodies = texts.where("text is not null").select(mark_of(F.col("text")).alias("mark"), "text").join(sized(marks), "mark", "left_semi")
    return _places(bodies.groupBy("mark").agg(F.first("text").alias("text")), terms)


def frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term``, ``places``: how often each of ``terms`` stands in ``text``, counted before any shuffle."""
    words = texts.select(F.explode(raw_words(F.col("text"))).alias("raw")).select(low(F.col("raw")).alias("term"))
    return _meet(words, terms.select("term")).groupBy("term").agg(F.count("*").alias("places"))


def phrases_of(items: DataFrame, window: int | None = WINDOW) -> DataFrame:
    """``item``, ``words``: the different windows of each text; one of all words where it has fewer, or
    without ``window``. Texts without words give none."""
    at = items.select("item", F.transform(raw_words(F.col("text")), low).alias("words")).where("size(words) > 0")
    if window is None:
        return at.distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return at.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words")).distinct()


def led(phrases: DataFrame, places: DataFrame, leads: int = LEADS) -> DataFrame:
    """``words``, ``leads``: different phrases with their rarest places (``offset``, ``term``), rarest first.

    A phrase with a term that stands nowhere is left out, as it stands nowhere.
    """
    each = phrases.select("words").distinct().select("words", F.posexplode("words").alias("offset", "term"))
    each = each.join(places, "term", "left")
    found = each.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("places", "offset", "term"))).alias("leads"), F.count_if(F.col("places").isNull()).alias("absent"))
    return found.where("absent = 0").select("words", F.slice("leads", 1, leads).alias("leads"))


def _candidates(index: DataFrame, phrases: DataFrame, leads: int) -> DataFrame:
    """``phrase``, ``mark``, ``start``: where the leads of a phrase stand as in the phrase."""
    for k in range(leads):
        lead = F.get("leads", F.lit(k))
        if k == 0:
            mine = phrases.select("phrase", lead["term"].alias("term"), lead["offset"].alias("offset"))
            at = _meet(index, materialise(mine, "leads")).where("pos >= offset").select("phrase", "mark", (F.col("pos") - F.col("offset")).alias("start"))
            continue
        asked = at.join(sized(materialise(phrases.select("phrase", lead["term"].alias("term"), lead["offset"].alias("offset")), "leads")), "phrase")
        alone = asked.where("term is null").select("phrase", "mark", "start")  # phrases of fewer words
        asked = asked.where("term is not null").withColumn("pos", F.col("start") + F.col("offset"))
        at = asked.join(index, ["term", "mark", "pos"], "left_semi").select("phrase", "mark", "start").unionByName(alone)
    return at


def _led(texts: DataFrame, phrases: DataFrame, leads: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The terms of the phrases; the phrases (``phrase``, ``words``, ``leads``); the stored index of their leads."""
    terms = materialise(phrases.select(F.explode("words").alias("term")).distinct(), "terms")
    places = materialise(frequencies(texts, terms), "places")
    known = materialise(led(phrases, places, leads).withColumn("phrase", F.md5(F.array_join("words", " ").cast("binary"))), "phrases")
    rare = materialise(known.select(F.explode("leads.term").alias("term")).distinct(), "lead-terms")
    return terms, known, materialise(postings(texts, rare), "postings")


def exact_matches(texts: DataFrame, phrases: DataFrame, leads: int = LEADS) -> DataFrame:
    """``mark``, ``phrase``, ``words``, ``start``: every place where the words of a phrase follow each other.

    ``texts`` has ``text``, ``phrases`` has ``words`` (array of string, lowered, not empty). Places are
    those of different texts, told by ``mark_of``, and ``phrase`` is a digest of the words. Repeated rows
    change nothing; an empty table on either side gives an empty one.
    """
    terms, known, index = _led(texts, phrases, leads)
    found = materialise(_candidates(index, known, leads).distinct(), "candidates")
    lists = _postings_of(texts, materialise(found.select("mark").distinct(), "marks"), terms)
    asked = found.join(sized(known.select("phrase", "words")), "phrase")
    each = asked.select("phrase", "mark", "start", F.size("words").alias("of"), F.posexplode("words").alias("offset", "term")).withColumn("pos", F.col("start") + F.col("offset"))
    whole = each.join(lists, ["mark", "pos", "term"]).groupBy("phrase", "mark", "start").agg(F.count("*").alias("n"), F.first("of").alias("of")).where("n = of")
    return whole.select("phrase", "mark", "start").join(sized(known.select("phrase", "words")), "phrase").select("mark", "phrase", "words", "start")


def proximity_matches(texts: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """``mark``, ``phrase``, ``words``, ``start``: where the words of a phrase stand close, in any order.

    At ``start`` stands a word of the phrase, and the ``width`` words from there on hold each word of the
    phrase as often as the phrase does. Tables and marks are those of ``exact_matches``. The lists of the
    two rarest words tell in which texts to look.
    """
    terms, known, index = _led(texts, phrases, 2)
    block = F.floor(F.col("pos") / width)
    lead = lambda k: _meet(index, materialise(known.select("phrase", F.get("leads", F.lit(k))["term"].alias("term")).where("term is not null"), "leads")).select("phrase", "mark", "pos")
    first = lead(0).select("phrase", "mark", F.col("pos").alias("at"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    near = first.join(lead(1).withColumn("block", block), ["phrase", "mark", "block"]).where(F.abs(F.col("at") - F.col("pos")) < width).select("phrase", "mark")
    single = lead(0).join(sized(known.where("size(leads) = 1").select("phrase")), "phrase", "left_semi").select("phrase", "mark")
    found = materialise(near.unionByName(single).distinct(), "candidates")
    lists = _postings_of(texts, materialise(found.select("mark").distinct(), "marks"), terms)
    needs = known.select("phrase", "words", F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.size(F.filter("words", lambda x: x == w)).alias("times"))).alias("needs"))
    each = found.join(sized(materialise(needs, "needs")), "phrase").select("phrase", "mark", "words", "needs", F.explode("needs.term").alias("term"))
    ahead = Window.partitionBy("phrase", "mark").orderBy("pos").rangeBetween(0, width - 1)
    held = each.join(lists, ["mark", "term"]).withColumn("held", F.collect_list("term").over(ahead))
    return held.where(F.forall("needs", lambda n: F.size(F.filter("held", lambda x: x == n["term"])) >= n["times"])).select("mark", "phrase", "words", F.col("pos").alias("start"))


def contamination(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, leads: int = LEADS) -> DataFrame:
    """The columns ``keep`` of every row with ``n_words``, ``n_hit``, ``spans`` and ``items``.

    A window is ``window`` consecutive words of a benchmark text, or all of fewer. ``n_hit`` words lie in a
    place of some window, ``spans`` (``start``, ``stop``: words counted from 0, end excluded) are the
    stretches of them, and ``items`` the ids whose windows these are (a null id is left out, repeated ones
    are one). Rows with a null text, or one without words, have none. Repeated rows stay; an empty table
    gives an empty one, an empty benchmark no hits. Columns of ``keep`` named like those made here are left
    out.
    """
    made = ["n_words", "n_hit", "spans", "items"]
    keep = [c for c in keep if c not in made]
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    windows = materialise(phrases_of(benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")), window), "windows")
    found = materialise(exact_matches(texts, windows, leads), "matches")
    places = found.select("mark", F.struct("start", (F.col("start") + F.size("words")).alias("stop")).alias("span")).distinct()
    spans = F.aggregate(F.array_sort(F.collect_list("span")), F.array().cast("array<struct<start:int,stop:int>>"), _merged)
    hits = places.groupBy("mark").agg(spans.alias("spans"))
    owners = windows.select("item", F.md5(F.array_join("words", " ").cast("binary")).alias("phrase")).where("item is not null")
    items = found.select("mark", "phrase").distinct().join(sized(materialise(owners, "owners")), "phrase").groupBy("mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = sized(materialise(hits.join(items, "mark", "left"), "hits"))
    rows = df.select(row_of(keep), F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), mark_of(F.col(f"`{text}`").cast("string")).alias("mark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    none = F.array().cast(hits.schema["items"].dataType)
    out = rows.join(hits, "mark", "left").select("row", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType)).alias("spans"), F.coalesce("items", none).alias("items"))
    return out.select(*fields_of(keep), *made)


def _merged(spans: Column, span: Column) -> Column:
    """Spans with one more that starts no earlier; it lengthens the last one where they touch."""
    last = F.get(spans, F.size(spans) - 1)
    longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
    touch = (F.size(spans) > 0) & (span["start"] <= last["stop"])
    return F.when(touch, F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(longer))).otherwise(F.concat(spans, F.array(span)))
