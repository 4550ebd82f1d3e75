"""Operator 9: benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words that hold numbers, units after numbers and names become typed placeholders; case and punctuation go.
Windows of five template words of the documents are hash-joined to those of the benchmark items. What is a
name shows in its case, which a copy may have lost: windows that hold names are joined in lower case too,
with the names as they are. A window of numbers and units alone says nothing by its types, and every table of
figures is full of them, so these are joined by their values. Matches on one diagonal (document position minus
item position) align a document with an item, word by word; an alignment found so takes in the windows of
placeholders alone whose types agree on it. An alignment is consistent if values of the item's slots and of
the document go one to one, by type, as in a copy or a question asked again with other parameters. A document
is contaminated by an item if at least 0.8 of the item's words are in matching windows of one consistent
alignment, of those alignments that change no slot, or of all alignments if they are consistent with each other.

Windows meet as (row, position, hash): the benchmark's are broadcast only if they are at most
``MAX_BROADCAST``, and shuffled by hash beyond. Texts never join windows; those of the documents found are
read again by their keys, as a row per word, to fill the slots. An alignment is a row that grows with the item,
never with the document: a document of a hundred thousand numbers has that many rows, not one row of them.

Cases: null or empty texts and items, and those of fewer than five template words, have no windows and match
nothing; rows with a null doc_id take part and report null; rows alike in doc_id and text report once;
items alike in item_id and text count once, and those that share only the item_id report each for itself;
texts that differ only in case or punctuation report alike; extra columns are ignored; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.rowkeys import text_hash, without
from chronoweave.plans.storage import broadcast_if_small, materialize, pick

WINDOW = 5
COVERAGE = 0.8
#: Rows (hash, item, position) of benchmark windows that are sent to every executor, at most.
MAX_BROADCAST = 500_000

#: Placeholders, in characters that survive the removal of punctuation.
NUMBER, UNIT, NUMBER_UNIT, NAME = "\u0001", "\u0002", "\u0003", "\u0004"
UNITS = (
    "kilometers|kilometres|kilometer|kilometre|meters|metres|meter|metre|centimeters|centimetres|millimeters|millimetres|km|cm|mm|m|"
    "miles|mile|feet|foot|ft|inches|inch|in|yards|yard|yd|kilograms|kilogram|kg|grams|gram|mg|g|tons|tonnes|ton|pounds|pound|lbs|lb|oz|"
    "liters|litres|liter|litre|ml|l|gallons|gallon|seconds|second|sec|s|minutes|minute|min|hours|hour|hrs|hr|h|days|day|weeks|week|"
    "months|month|years|year|mph|kmh|dollars|dollar|cents|cent|euros|euro|percent|degrees|degree"
)
_TAIL = "[.,;:!?)\\]}\"']*(?!\\S)"
_DIGITS = "[-+]?\\d[\\d.,:/]*"
_NUMBER_UNIT = f"(?<!\\S)[(\\[{{\"'$]*{_DIGITS}(?i:{UNITS}){_TAIL}"
_NUMBER = f"(?<!\\S)[(\\[{{\"'$#]*{_DIGITS}(?:st|nd|rd|th)?%?{_TAIL}"
_UNIT = f"(?<={NUMBER} )(?i:{UNITS}){_TAIL}"
#: Words that open sentences and are no names, wherever they are capitalised: an item reads alike at any place of a text.
OPENERS = (
    "The|A|An|I|He|She|It|We|You|They|This|That|These|Those|There|Here|My|His|Her|Its|Our|Your|Their|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|"
    "In|On|At|Of|By|For|From|With|Without|To|And|But|Or|So|If|As|After|Before|During|Between|Among|Over|Under|Through|About|Into|Against|Until|Unless|Since|"
    "When|Where|While|What|Which|Who|Whose|Whom|Why|How|Whether|Because|Although|Though|However|Thus|Hence|Therefore|Then|Now|Once|Also|Not|No|Yes|"
    "Is|Are|Was|Were|Be|Do|Does|Did|Has|Have|Had|Can|Could|Should|Would|Each|Every|All|Some|Any|Many|Most|Both|Another|Other|Such|"
    "First|Second|Third|Next|Last|Finally|Let|Find|Given|Suppose|Consider|Calculate|Compute|Determine|Evaluate|Explain|Solve|Write|Assume|Question|Answer"
)
_BY_LETTER = "|".join(f"{c}(?:{'|'.join(w[1:] for w in OPENERS.split('|') if w[0] == c)})" for c in sorted({w[0] for w in OPENERS.split("|")}))
#: Any capitalised word after a lower-case word, comma, semicolon or placeholder; anywhere else only one with small letters, or an initial.
_CAPITALISED = (
    f"(?<!\\S)[(\\[{{\"'“‘«]*+\\p{{Lu}}(?:(?<=[\\p{{Ll}},;{NUMBER}-{NAME}] \\p{{Lu}})|(?=[\\p{{L}}'’-]*\\p{{Ll}}|\\.))"
    f"(?<!(?=(?:{_BY_LETTER})(?![\\p{{L}}'’-])).)[\\p{{L}}'’-]*+"
)
_NAME = f"{_CAPITALISED}[.,;:!?)\\]}}\"'”’»]*(?!\\S)"
_PUNCTUATION = "[\\p{Punct}“”‘’«»]+"
_BLANKS = "[\\x20\\t-\\r]+"
#: A window of numbers and units alone; what sets hashes of values apart from hashes of words.
_FIGURES = f"(?:(?<!\\S)[{NUMBER}-{NUMBER_UNIT}]\\S*{_BLANKS}){{{WINDOW - 1}}}[{NUMBER}-{NUMBER_UNIT}]"
VALUES = "\u0005"


def template(text: Column) -> Column:
    """The text with placeholders, lower case, without punctuation; names stay behind their mark. Word for word beside :func:`plain_words`."""
    with_numbers = F.regexp_replace(F.regexp_replace(text, _NUMBER_UNIT, NUMBER_UNIT), _NUMBER, NUMBER)
    numbered = F.when(text.rlike("\\d"), F.regexp_replace(with_numbers, _UNIT, UNIT)).otherwise(text)
    return F.lower(F.regexp_replace(F.regexp_replace(numbered, _NAME, NAME + "$0"), _PUNCTUATION, ""))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, _BLANKS), "")


def plain_words(text: Column) -> Column:
    return _words(F.lower(F.regexp_replace(text, _PUNCTUATION, "")))


def _windows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``(*keep, pos, w)``: the hashes of every window of template words, and its place.

    Windows with a word that is no placeholder by types; with names, as they are too; of numbers and units alone by values.
    """
    line = template(F.col("text"))
    values = F.when(line.rlike(_FIGURES), F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(F.lit(VALUES), w)))
    words = rows.select(*keep, _words(line).alias("words"), F.coalesce(values, F.array().cast("array<long>")).alias("valued"))
    typed = F.transform("words", lambda w: F.xxhash64(F.when(w.startswith(NAME), F.lit(NAME)).otherwise(w)))
    named = F.transform("words", lambda w: F.xxhash64(F.ltrim(w, F.lit(NAME))))
    words = words.select(*keep, typed.alias("typed"), named.alias("named"), "valued")
    shifts = lambda kind: [F.slice(kind, F.lit(1 + j), F.size(kind)).alias(f"{kind}{j}") for j in range(WINDOW)]
    # hashes of values are made here, as few texts have any
    by_values = F.transform(F.arrays_zip(*shifts("valued")), lambda z: F.xxhash64(*[z[f"valued{j}"] for j in range(WINDOW)]))
    zipped = words.select(*keep, F.arrays_zip(*shifts("typed"), *shifts("named"), by_values.alias("w3")).alias("windows"))
    # outer: an inner explode makes the optimizer repeat the whole expression in a filter below
    spread = zipped.select(*keep, F.posexplode_outer("windows").alias("pos", "v"))
    column = lambda kind: [F.col(f"v.{kind}{j}") for j in range(WINDOW)]
    spread = spread.where(F.col(f"v.named{WINDOW - 1}").isNotNull())
    alone = lambda marks: reduce(and_, [c.isin(*[F.xxhash64(F.lit(m)) for m in marks]) for c in column("typed")])
    figures, placeholders = alone((NUMBER, UNIT, NUMBER_UNIT)), alone((NUMBER, UNIT, NUMBER_UNIT, NAME))
    both = spread.select(
        *keep, "pos", figures.alias("figures"), placeholders.alias("placeholders"),
        F.xxhash64(*column("typed")).alias("w"), F.xxhash64(*column("named")).alias("w2"), F.col("v.w3").alias("w3"),
    )
    hashes = F.when(F.col("figures"), F.array("w3")).when(F.col("placeholders"), F.array("w2")).when(F.col("w") == F.col("w2"), F.array("w")).otherwise(F.array("w", "w2"))
    return both.select(*keep, "pos", F.explode(hashes).alias("w"))


def _kinds(words: Column) -> Column:
    return F.transform(words, lambda w: F.when((w >= NUMBER) & (w < VALUES), F.substring(w, 1, 1)))


def _covered(at: Column) -> Column:
    """The places of the windows that start ``at``, in an item."""
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + (WINDOW - 1)))))


def _one_to_one(slots: Column) -> Column:
    """Whether different slots hold different values of the item and different values of the document, by type."""
    several = lambda side: F.size(F.array_distinct(F.transform(slots, lambda s: F.concat(s["kind"], s[side]))))
    return (several("item") == F.size(slots)) & (several("doc") == F.size(slots))


def alignments(rows: DataFrame, bench: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """``(t, u, item, item_id, n_words, diagonal, words, slots)``: alignments of texts and items whose matching windows may hold enough words.

    ``rows`` are (doc_id, text, t, u), t and u the text's hashes. words are places in the item; slots are
    different structs of type, value in the item and value in the document.
    """
    items = pick(bench, item_col, item_text_col).toDF("item_id", "text").where("text is not null").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    asked = items.select("item", "item_id", _kinds(_words(template(F.col("text")))).alias("kinds"), plain_words(F.col("text")).alias("item_words"))
    # windows of placeholders alone, which an alignment takes in if types agree
    starts = F.filter(F.sequence(F.lit(0), F.size("kinds") - WINDOW), lambda i: F.forall(F.slice("kinds", i + 1, WINDOW), lambda k: k.isNotNull()))
    asked = asked.withColumn("free", F.when(F.size("kinds") >= WINDOW, starts).otherwise(F.array().cast("array<int>")))
    asked = materialize(asked.withColumn("n_words", F.size("kinds")), "benchmark")
    shown = materialize(_windows(items, ["item"]).toDF("item", "item_pos", "w").distinct(), "benchmark-windows")
    met = _windows(rows, ["t", "u"]).join(broadcast_if_small(shown, MAX_BROADCAST), "w")
    key = ["t", "u", "item", "diagonal"]
    aligned = met.withColumn("diagonal", F.col("pos") - F.col("item_pos")).groupBy(*key).agg(F.collect_set("item_pos").alias("at"))
    aligned = materialize(aligned, "diagonals")
    # an item's places bound what a pair of text and item gathers here
    pairs = aligned.select("t", "u", "item", F.explode("at").alias("at")).groupBy("t", "u", "item").agg(F.collect_set("at").alias("at"))
    pairs = pairs.join(asked.select("item", "free", "n_words"), "item")
    pairs = pairs.where(F.size(_covered(F.concat("at", "free"))) >= COVERAGE * F.col("n_words"))
    pairs = materialize(pairs.select("t", "u", "item"), "pairs")
    kept = materialize(aligned.join(pairs, ["t", "u", "item"], "left_semi").join(asked, "item"), "alignments")
    texts = rows.join(broadcast_if_small(pairs.select("t", "u").distinct(), MAX_BROADCAST), ["t", "u"], "left_semi")
    texts = texts.groupBy("t", "u").agg(F.first("text").alias("text"))
    kinds = _kinds(_words(template(F.col("text")))).alias("kind")
    said = texts.select("t", "u", F.arrays_zip(kinds, plain_words(F.col("text")).alias("word")).alias("said"))
    said = said.select("t", "u", F.posexplode("said").alias("place", "said"))
    said = materialize(said.select("t", "u", F.col("place").cast("long"), "said.kind", "said.word"), "words-of-documents")
    # a row for each slot of the item in each alignment: what the document says there
    slots = F.filter(F.sequence(F.lit(0), F.col("n_words") - 1), lambda j: F.get("kinds", j).isNotNull())
    open_ = kept.select(*key, F.explode(slots).alias("j")).withColumn("place", (F.col("j") + F.col("diagonal")).cast("long"))
    here = open_.join(said, ["t", "u", "place"]).groupBy(*key).agg(F.collect_list(F.struct("j", "kind", "word")).alias("here"))
    whole = kept.join(here, key, "left").withColumn("here", F.coalesce("here", F.array().cast(here.schema["here"].dataType)))
    agree = F.transform(F.filter("here", lambda x: x["kind"] == F.get("kinds", x["j"])), lambda x: x["j"])
    whole = whole.withColumn("agree", agree)
    taken = F.filter("free", lambda i: F.forall(F.sequence(i, i + (WINDOW - 1)), lambda j: F.array_contains("agree", j)))
    whole = whole.withColumn("words", _covered(F.concat("at", taken)))
    filled = F.filter("here", lambda x: F.array_contains("words", x["j"]))
    filled = F.transform(filled, lambda x: F.struct(F.get("kinds", x["j"]).alias("kind"), F.get("item_words", x["j"]).alias("item"), x["word"].alias("doc")))
    return whole.select(*key, "item_id", "n_words", "words", F.array_distinct(filled).alias("slots"))


def contaminated(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, t, item_id, n_matched, n_words, coverage, n_slots, reworded)`` of every contaminated document and item.

    t is the text's 64-bit hash; n_matched and n_words count words of the item; reworded: only alignments in
    which some slot holds another value than the item's cover enough.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").where("text is not null")
    rows = rows.withColumns({"t": text_hash(F.col("text")), "u": F.xxhash64(F.lit(1), "text")})
    found = materialize(alignments(rows, bench, item_col, item_text_col), "slots")
    pair = ["t", "u", "item"]
    same = F.forall("slots", lambda s: s["item"] == s["doc"])
    found = found.withColumns({"same": same.cast("int"), "one": F.when(_one_to_one(F.col("slots")), F.size("words"))})
    best = found.groupBy(*pair).agg(F.first("item_id").alias("item_id"), F.first("n_words").alias("n_words"), F.coalesce(F.max("one"), F.lit(0)).alias("one"))
    places = found.select(*pair, "same", F.explode("words").alias("place")).groupBy(*pair, "place").agg(F.max("same").alias("same"))
    places = places.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_places"), F.sum("same").alias("as_is"))
    every = found.select(*pair, F.explode("slots").alias("s")).select(*pair, F.col("s.kind").alias("kind"), F.col("s.item").alias("ours"), F.col("s.doc").alias("theirs")).distinct()
    several = [F.count(F.lit(1)).alias("n_slots"), F.count_distinct("kind", "ours").alias("n_ours"), F.count_distinct("kind", "theirs").alias("n_theirs")]
    best = best.join(places, pair).join(every.groupBy(*pair).agg(*several), pair, "left").fillna(0, ["n_slots", "n_ours", "n_theirs"])
    all_agree = (F.col("n_ours") == F.col("n_slots")) & (F.col("n_theirs") == F.col("n_slots"))
    best = best.withColumn("n_matched", F.greatest("as_is", "one", F.when(all_agree, F.col("n_places")).otherwise(0)))
    enough = F.lit(COVERAGE) * F.col("n_words")
    best = materialize(best.where(F.col("n_matched") >= enough), "contaminated-texts")
    named = rows.select("doc_id", "t", "u").join(broadcast_if_small(best, MAX_BROADCAST), ["t", "u"])
    return named.dropDuplicates(["doc_id", *pair]).select(
        "doc_id", "t", "item_id", F.col("n_matched").cast("long").alias("n_matched"), F.col("n_words").cast("long").alias("n_words"),
        F.round(F.col("n_matched") / F.col("n_words"), 6).alias("coverage"), F.col("n_slots").cast("long").alias("n_slots"),
        (F.col("as_is") < enough).alias("reworded"),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns kept."""
    gone = contaminated(docs, bench, id_col, text_col).select("doc_id", "t").distinct()
    return without(docs, materialize(gone, "contaminated"), id_col, text_col)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("t")
