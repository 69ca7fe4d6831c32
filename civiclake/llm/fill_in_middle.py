"""Fill-in-middle: cut each text at two line ends and move its middle to the end.

``regexp_count`` gives the number of units (lines) of a text. Two hashes choose how many units end the prefix (a) and the middle (b). A pattern made
for the row, with the groups ``(unit{a}+)(unit{b-a}+)(rest)``, captures the three parts in one match. The counted groups are
possessive, so the engine steps through them in a loop, without a stack frame per line and without going back, however long the text is.

All work is built-in expressions in one narrow pass; there is no shuffle.

Nulls: a null text counts as empty, and a null doc_id hashes as the empty string. An empty text, one that holds a marker, and one
that the draw leaves out are plain: the output is the text itself. Repeated rows pass row by row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import text_or_empty
from civiclake.llm.suite import LLM

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE = r"[^\n]*\n|[^\n]+"
STEADY_LINE = r"[^\n]*+\n|[^\n]++"  # the same lines, without going back inside one


def _draw(group: int, digest: str = "digest") -> Column:
    """One of the 8-digit groups of a hex digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def cut_lines(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix: whole texts and their parts; ``rate`` and ``spm`` are percentages.

    The parts of a plain text are null.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(ids, text_or_empty(), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256).alias("digest"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(LINE)).cast("long"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (_draw(3) % 100 >= rate)
    units = F.col("n") + 1
    rows = rows.withColumns({
        "form": F.when(plain, "plain").when(_draw(4) % 100 < spm, "spm").otherwise("psm"),
        "a": F.least(_draw(1) % units, _draw(2) % units),
        "b": F.greatest(_draw(1) % units, _draw(2) % units),
    })
    pattern = F.concat(F.lit(rf"\A((?:{STEADY_LINE}){{"), "a", F.lit(rf"}}+)((?:{STEADY_LINE}){{"), F.col("b") - F.col("a"), F.lit(r"}+)((?s).*+)\z"))
    # No marker is in the text, so the marked-up copy falls apart at the two marks put in.
    marked_up = F.regexp_replace("text", pattern, F.lit(f"$1{MIDDLE}$2{SUFFIX}$3"))
    rows = rows.withColumn("parts", F.when(F.col("form") != "plain", F.split(marked_up, f"{MIDDLE}|{SUFFIX}", 3)))
    return rows.select("doc_id", "text", "n", "form", *[F.get("parts", F.lit(i)).alias(name) for i, name in enumerate(("prefix", "middle", "suffix"))])


def assemble(cuts: DataFrame) -> DataFrame:
    """The rows of ``cut_lines`` with the training text in ``output``."""
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return cuts.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(rows: DataFrame) -> DataFrame:
    """Rows with output and form, and the text that each output was made from in ``restored``."""
    part = lambda i: F.get("_pieces", F.lit(i))
    whole = F.when(F.col("form") == "psm", F.concat(part(1), part(3), part(2))).when(F.col("form") == "spm", F.concat(part(2), part(3), part(1)))
    pieces = F.when(F.col("form") != "plain", F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4))
    return rows.withColumn("_pieces", pieces).withColumn("restored", whole.otherwise(F.col("output"))).drop("_pieces")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix, output."""
    return assemble(cut_lines(docs, seed, rate, spm))


FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS parts FROM d),
u AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN ends_with(t, chr(10)) THEN len(parts) - 1 ELSE len(parts) END AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM l),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (SELECT *,
    array_to_string(parts[1:a], chr(10)) || CASE WHEN a > 0 AND (a < n OR ends_with(t, chr(10))) THEN chr(10) ELSE '' END AS p,
    array_to_string(parts[1:b], chr(10)) || CASE WHEN b > 0 AND (b < n OR ends_with(t, chr(10))) THEN chr(10) ELSE '' END AS q FROM c),
f AS (SELECT *, substr(q, length(p) + 1) AS m, substr(t, length(q) + 1) AS s FROM e)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM f
"""


@LLM.query("op11_fill_in_middle", FIM_SQL)
def op11_fill_in_middle(t) -> DataFrame:
    rows = restore(fill_in_middle(t.documents))
    chars = lambda name: F.length(name).cast("long").alias(f"{name}_chars")
    digest = lambda name: F.sha2(name, 256).alias(f"{name}_sha256")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest("output"), digest("restored"))
