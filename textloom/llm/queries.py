"""The queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import confusables, encoding, layout, mixing, near_duplicates, packing, sentences, tokens
from textloom.session import cut, table


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or over all cores if its files make fewer partitions than half of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def placed(df: DataFrame, place: str, value: str) -> DataFrame:
    return spread(df.select(F.lit(place).alias("place"), "key", F.col(value).alias("value")))


def kept(df: DataFrame, test: Callable[..., bool], columns: list[str]) -> DataFrame:
    """The named columns of the rows whose remaining columns pass the test; Arrow batches, no shuffle."""
    names = df.columns
    own = [names.index(c) for c in columns]
    rest = [i for i, c in enumerate(names) if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array([test(*x) for x in zip(*(b.column(i).to_pylist() for i in rest))], pa.bool_())
            yield b.select(own).filter(mask)

    return df.mapInArrow(run, df.select(*columns).schema)


def _garbled(value: str | None) -> bool:
    return encoding.is_case(value)


def _skip_garbled(place: str, value: str) -> bool:
    return encoding.is_case(value)


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    values = placed(table(spark, sf_dir, "contents"), "content", "content").unionByName(placed(table(spark, sf_dir, "files"), "name", "name"))
    return near_duplicates.near_duplicates(values, {"content": ("words", 3), "name": ("characters", 3)}, 0.6, _skip_garbled)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.record_pairs(*_near(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(*_near(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = placed(table(spark, sf_dir, "contents"), "content", "content").unionByName(placed(table(spark, sf_dir, "files"), "name", "name"))
    return kept(values, _garbled, ["place", "key"]).distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = placed(table(spark, sf_dir, "contents"), "content", "content").unionByName(placed(table(spark, sf_dir, "files"), "name", "name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, k, r, r != v) for p, k, v in zip(*(b.column(i).to_pylist() for i in range(3))) for g, r in [encoding.examine(v)] if g]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.bool_())], names=["place", "key", "restored", "changed"])

    return values.mapInArrow(run, "place string, key string, restored string, changed boolean").distinct()


def _disguised(look: confusables.Look) -> Callable[..., bool]:
    return lambda value, raw: look.disguised(value) and not encoding.is_case(raw)


def _look_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "contents").select(F.lit("content").alias("place"), "key", F.col("content").alias("value"), F.col("content").alias("raw")))
    return c.unionByName(spread(table(spark, sf_dir, "files").select(F.lit("name_lc").alias("place"), "key", F.col("name_lc").alias("value"), F.col("name").alias("raw"))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(_look_values(spark, sf_dir), _disguised(confusables.look()), ["place", "key"]).distinct()


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, look = _look_values(spark, sf_dir), confusables.look()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, k, c) for p, k, v in zip(*(b.column(i).to_pylist() for i in range(3))) for c in [look.canonical(v)] if c != v]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["place", "key", "canonical"])

    return values.drop("raw").mapInArrow(run, "place string, key string, canonical string").distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that look the same, contents and names each among themselves: groups of more than one written form."""
    return confusables.look_alike_groups(_look_values(spark, sf_dir), "value", ("place",)).where("forms > 1")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "contents").select(F.lit("contents").alias("place"), "key", F.col("content").alias("text")))
    return c.unionByName(spread(table(spark, sf_dir, "extracted").select(F.lit("extracted").alias("place"), "key", "text")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _pages(spark, sf_dir)
    counts = cut(layout.word_counts(texts, "text"), "words")
    return layout.findings(texts, counts, cut(layout.misread_words(counts), "misread"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("place", "key", "line_no", "kind").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every record that had anything to repair."""
    found = _lines(spark, sf_dir).distinct()
    edits = cut(found.groupBy("place", "key").agg(F.collect_list(F.struct("line_no", "kind", "word", "right")).alias("edits")), "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for place, key, text, edits in zip(*(b.column(i).to_pylist() for i in range(4))):
                drop = {e["line_no"] for e in edits if e["kind"] == "drop"}
                join = {e["line_no"] for e in edits if e["kind"] == "join"}
                fix: dict = {}
                for e in sorted(edits, key=lambda e: (e["line_no"], e["word"] or "")):
                    if e["kind"] == "misread" and e["right"]:
                        fix.setdefault(e["line_no"], []).append((e["word"], e["right"]))
                out.append((place, key, layout.paragraphs(text, drop, join, fix)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["place", "key", "text"])

    # Only texts with edits are shuffled; the join leaves repeated rows side by side.
    texts = near_duplicates.only(_pages(spark, sf_dir), edits).join(edits, ["place", "key"]).dropDuplicates(["place", "key", "text"])
    return texts.select("place", "key", "text", "edits").mapInArrow(run, "place string, key string, text string")


def _sizes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return cut(tokens.sized(spread(table(spark, sf_dir, "documents").select("doc_id", *columns, "text")), "text"), "sizes")


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The capacities to try: a parameter table of fixed size."""
    return [(r[0], r[1]) for r in table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").collect()]


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _capacities(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p6_packed(spark, sf_dir), _capacities(spark, sf_dir))


def _mixed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A mix as large as the whole corpus; scarce sources run dry at their cap."""
    return mixing.mix(sizes, targets, budget=mixing.available(sizes, targets))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets")
    return mixing.report(_mixed(sizes, targets), targets, sizes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.units(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units a document has and how long they are on average."""
    length = F.col("sent_end") - F.col("sent_start")
    return p8_found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("units"), F.max(length).alias("longest"), F.sum(length).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_classes, p2_found, p2_repaired, p3_found, p3_restored, p5_found, p5_canonical, p5_groups, p6_packed, p6_report, p7_mix, p7_report, p8_found, p8_counts)
}
SQL: dict[str, str] = {}
