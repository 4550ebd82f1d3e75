"""Operator 12: fill-in-middle transformation over relational units.

The units of a text are the matches of a pattern, left to right; a code point that it doesn't match is a unit
too, so units cover the text. They become rows by posexplode, ``BLOCK`` units to a row; a window sums the
lengths of the rows before each. A document asks for two cuts by unit ordinal: the requests are joined with
the row that holds the ordinal, and the units of that row before it are added, which gives the place of a cut
in code points. Places are aggregated per document, join it again by its key, and substrings are put in order
around the marks. Blocks don't change a place (tests compare them with rows of one unit): they keep the rows
at 1/256 of the units, so that what is shuffled is small beside the texts. A row keeps its text only where a
request falls into it.

What cuts a document and gives its form is a hash of its doc_id. Cases: a null text counts as empty; an empty
text, one that holds a mark, and a row without doc_id stay plain; rows alike in doc_id and text are cut alike and
all given; a pattern mustn't match the empty string; extra input columns are ignored; an empty table gives an
empty result. Places go to every executor if they are at most ``MAX_BROADCAST_IDS`` rows, else by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.llm.rowkeys import MAX_BROADCAST_IDS, REPEATED, keyed
from chronoweave.plans.storage import broadcast_if_small, materialize

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s)."
BLOCK = 256
#: Of a hundred documents that can be cut, so many are; of a hundred cut, so many give the suffix first.
CUT, SUFFIX_FIRST = 90, 20


def _drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut_places(rows: DataFrame, unit: str = CODE_POINT, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``(k, t, n, first, second)``: units of each keyed text and the places, in code points, after which prefix and middle end."""
    one = f"(?:{unit})|(?s:.)"
    many = f"(?:{one}){{1,{block}}}+"
    units = lambda text: F.regexp_extract_all(text, F.lit(one), 0)
    h = _drawn(F.col("doc_id"), seed)
    parts = rows.select("k", "t", "doc_id", F.regexp_extract_all("text", F.lit(many), 0).alias("parts")).where(F.size("parts") > 0)
    counted = parts.withColumn("n", (F.size("parts") - 1).cast("long") * block + F.size(units(F.element_at("parts", -1))))
    cut = lambda i: h[i] % (F.col("n") + 1)
    # the row that holds a cut; a cut after all units is in the last
    row_of = lambda ordinal: F.least(F.floor(ordinal / block), F.size("parts") - 1)
    counted = counted.withColumns({"x": F.least(cut(0), cut(1)), "y": F.greatest(cut(0), cut(1))})
    requests = counted.select("k", "t", "n", F.explode(F.array(*[F.struct(F.col(c).alias("ordinal"), row_of(F.col(c)).alias("g")) for c in ("x", "y")])).alias("r"))
    requests = requests.select("k", "t", "n", "r.g", "r.ordinal")
    spread = counted.select("k", "t", row_of(F.col("x")).alias("gx"), row_of(F.col("y")).alias("gy"), F.posexplode("parts").alias("g", "part"))
    held = F.when((F.col("g") == F.col("gx")) | (F.col("g") == F.col("gy")), F.col("part"))
    lengths = spread.select("k", "t", F.col("g").cast("long").alias("g"), F.char_length("part").cast("long").alias("chars"), held.alias("part"))
    if rows.schema["t"].metadata.get(REPEATED, True):
        requests = requests.distinct()
        lengths = lengths.groupBy("k", "t", "g").agg(F.first("chars").alias("chars"), F.first("part").alias("part"))
    before = Window.partitionBy("k", "t").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    summed = lengths.withColumn("at", F.coalesce(F.sum("chars").over(before), F.lit(0))).where("part is not null")
    met = summed.join(requests, ["k", "t", "g"])
    inside = F.slice(units(F.col("part")), F.lit(1), (F.col("ordinal") - F.col("g") * block).cast("int"))
    places = met.select("k", "t", "n", (F.col("at") + F.char_length(F.array_join(inside, ""))).alias("place"))
    return places.groupBy("k", "t").agg(F.first("n").alias("n"), F.min("place").alias("first"), F.max("place").alias("second"))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: int = 1,
    cut: int = CUT, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: every text plain or as prefix, suffix and middle (psm, spm) between marks.

    n counts units; characters are code points, null where the form is plain.
    """
    rows = keyed(docs, id_col, text_col)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    h = _drawn(F.col("doc_id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | F.coalesce(h[2] % 100 >= cut, F.lit(True))
    places = materialize(cut_places(rows, unit, seed, block), "cut-places")
    keyed_places = broadcast_if_small(places.toDF("_k", "_t", "n", "first", "second"), MAX_BROADCAST_IDS)
    whole = rows.join(keyed_places, (F.col("k") == F.col("_k")) & (F.col("t") == F.col("_t")), "left")
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    text, first, second = F.col("text"), F.col("first"), F.col("second")
    whole = whole.withColumns({"form": form, "_chars": F.char_length("text").cast("long")})
    prefix, suffix = F.substr(text, F.lit(1), first.cast("int")), F.substr(text, (second + 1).cast("int"))
    middle = F.substr(text, (first + 1).cast("int"), (second - first).cast("int"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return whole.select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "form", cut_only(first).alias("prefix_chars"),
        cut_only(second - first).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: a mark can't overlap another or a text without marks, so the first found is it."""

    def parts(second_mark: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(PREFIX) + 1))
        one = F.substring_index(rest, second_mark, 1)
        rest = F.substr(rest, F.char_length(one) + len(second_mark) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
with drawn as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents
), numbers as (
  select doc_id, t, n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from drawn
), cut as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as x, greatest(h1 % (n + 1), h2 % (n + 1)) as y,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or coalesce(h3 % 100 >= 90, true) then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from numbers
), parts as (
  select *, substr(t, 1, x) as prefix, substr(t, x + 1, y - x) as middle, substr(t, y + 1) as suffix from cut
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then x end::bigint as prefix_chars, case when form <> 'plain' then y - x end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
