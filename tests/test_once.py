"""What a lambda mentions is computed again at every element: costly values must be bound once."""

import datetime

from pyspark.sql import functions as F

from maskfold.operators import compact, detectors, entities, name_forms


def _times(column, what):
    return column._jc.toString().count(what)


def test_compact_names_lower_a_word_once(spark):
    assert _times(compact.names(F.col("text")), "lower(") <= 4


def test_dates_are_counted_and_not_parsed(spark):
    made = detectors.date(F.col("text"))
    assert _times(made, "to_date(") == 0 and _times(made, "lower(") <= 3
    rows = []
    for year in (0, 1, 1900, 2000, 2023, 2024, 9999):
        for month in range(14):
            for day in range(33):
                try:
                    real = bool(datetime.date(year, month, day))
                except ValueError:
                    real = False
                rows += [(f"{day:02d}.{month:02d}.{year:04d}", real), (f"{year:04d}-{month}-{day}", real)]
    got = spark.createDataFrame(rows, "v string, real boolean").withColumn("got", detectors._real_date(F.col("v")))
    assert got.where("not (got <=> real)").count() == 0


def test_endings_lower_a_word_once(spark):
    assert _times(name_forms._by_ending(F.col("w")), "lower(") == 1


def test_a_name_that_is_alone_is_resolved_as_in_python(spark, small):
    from maskfold.operators.decide import decided
    from maskfold.sources.names_corpus import names_corpus
    from maskfold.sources.tables import ru_corpus

    names = F.filter(entities.personal(F.col("decisions")), lambda d: (d["type"] == "FULL_NAME") & (F.size(d["meta"]["name_parts"]) > 0))
    in_python = F.udf(entities.resolve, f"array<{entities.PERSON}>", useArrow=True).asNondeterministic()(names)
    for docs in (ru_corpus(spark, small), names_corpus(spark, small)):
        both = decided(detectors.detect(docs, only=("fio",))).withColumn("new", entities.people(F.col("decisions"))).withColumn("old", in_python)
        assert both.where("size(old) = 1").count() > 0
        assert both.where("not (new <=> old)").count() == 0


def test_a_name_that_is_alone_is_not_sent_to_python(spark, small, monkeypatch):
    from maskfold.operators.decide import decided
    from maskfold.sources.names_corpus import names_corpus

    def several(mentions):
        assert len(mentions or ()) != 1
        return []

    monkeypatch.setattr(entities, "resolve", several)
    done = decided(detectors.detect(names_corpus(spark, small), only=("fio",))).select(F.size(entities.people(F.col("decisions"))).alias("n"))
    assert done.where("n = 1").count() > 0
