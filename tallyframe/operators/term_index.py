"""Which of many terms a text contains, read off in one pass or by an index of each term's rarest part.

Terms up to a checked size are sent to the tasks as one automaton, and each text is read once, however many terms
there are. Beyond that vocabularies stay tables: a text that contains a term contains every run of a few letters
of it, so each term is filed under the one of its runs that the fewest texts have, texts are joined with the file
on their runs, and the candidates are checked by the text itself. Candidates of a text grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.session import materialise

#: letters of a run; a shorter term is its own run
RUN = 4
#: terms are sent to the tasks only up to so many bytes, each with a few for its place
MAX_SENT_BYTES, TERM_BYTES = 8 * 1024 * 1024, 8
#: rows that a task turns into Python values at once
ROWS = 256


def runs(text: Column, length: int) -> Column:
    """The distinct runs of so many code points, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def _read_off(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One pass over the texts with an automaton of all terms, which each task builds once."""
    sent = texts.sparkSession.sparkContext.broadcast([r["term"] for r in wanted.collect()])
    layout = T.StructType([texts.schema["id"], wanted.schema["term"]])
    arrow = to_arrow_schema(layout, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = None
        for batch in batches:
            if automaton is None:
                automaton, names = ahocorasick.Automaton(ahocorasick.STORE_INTS), pa.array(sent.value, pa.string())
                for number, name in enumerate(sent.value):
                    automaton.add_word(name, number)
                automaton.make_automaton()
            for start in range(0, batch.num_rows, ROWS):
                part, rows, found = batch.slice(start, ROWS), [], []
                for row, value in enumerate(part.column("text").to_pylist()):
                    numbers = {number for _, number in automaton.iter(value)}
                    rows += [row] * len(numbers)
                    found += numbers
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows, pa.int32())).cast(arrow.field("id").type), names.take(pa.array(found, pa.int32()))], schema=arrow)

    return texts.select("id", "text").mapInArrow(run, layout)


def contained_terms(
    texts: DataFrame, terms: DataFrame, *, id: str = "id", text: str = "text", term: str = "term", run: int = RUN, max_bytes: int = MAX_SENT_BYTES,
) -> DataFrame:
    """``(id, term)``: every distinct term that occurs anywhere in the text of a distinct id, compared as written.

    Null and empty texts contain nothing; null and empty terms are in no text; repeated terms count once. Lower both
    sides first where case is not to matter. Terms of up to ``max_bytes`` are read off in one pass, others by runs.
    """
    wanted = materialise(terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct(), "terms")
    size = wanted.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0]
    if size is not None and size <= max_bytes:
        return _read_off(texts.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0), wanted)
    lengths = sorted(r[0] for r in wanted.select(F.least(F.length("term"), F.lit(run)).alias("n")).distinct().collect())  # at most ``run`` of them
    read = texts.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    if not lengths:
        return read.select("id", F.lit("").alias("term")).where(F.lit(False))
    own = F.when(F.length("term") < run, F.array("term")).otherwise(runs(F.col("term"), run))
    parts = wanted.select("term", F.explode(own).alias("run"))
    known = parts.select("run").distinct()
    spread = read.select("id", F.explode(F.flatten(F.array(*[runs(F.col("text"), n) for n in lengths]))).alias("run"))
    # only runs that some term has are kept, and counted before the terms are filed
    found = materialise(spread.join(known, "run", "left_semi"), "runs")
    counts = found.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # a run that no text has rules its term out
    order = Window.partitionBy("term").orderBy(F.coalesce("n", F.lit(0)), "run")
    filed = parts.join(counts, "run", "left").withColumn("_place", F.row_number().over(order)).where("_place = 1 and n is not null").select("run", "term")
    candidates = found.join(filed, "run").groupBy("id").agg(F.collect_set("term").alias("_terms"))
    checked = read.join(candidates, "id").select("id", "text", F.explode("_terms").alias("term"))
    return checked.where(F.col("text").contains(F.col("term"))).select("id", "term")
