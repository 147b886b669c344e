"""Input tables, the Russian corpus made from keys, and consumers' policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of :func:`spread` gets at least, where there are few, and at most, where there are many.
LEAST_ROWS, MOST_ROWS = 500, 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over tasks by ``key``, for work that takes a millisecond a row. A file is read by as many tasks as it has row groups, and one of narrow rows holds a million in each: all
    the work would be done by one core. Few rows stay where they are."""
    spark = rows.sparkSession
    n = rows.count()
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(min(2 * cores, n // LEAST_ROWS), -(-n // MOST_ROWS))
    return rows.repartition(tasks, key) if tasks > 1 else rows


def _pad(expression: str, n: int) -> str:
    return f"lpad(CAST({expression} AS STRING), {n}, '0')"


def _pick(words: str, expression: str) -> str:
    return f"split_part('{words}', ',', CAST(1 + CAST(floor({expression}) AS BIGINT) % {words.count(',') + 1} AS INT))"


_KEY = "c_custkey"
_FORMS = (
    f"'Клиент ' || {_pick('Иванов,Петров,Смирнов,Волков', f'{_KEY} / 16')} || ' Иван Петрович обратился за кредитом, паспорт ' || {_pad(f'{_KEY} % 10000', 4)} || ' ' || {_pad(f'({_KEY} * 7919) % 1000000', 6)} || '.'",
    f"'Дата рождения ' || {_pad(f'1 + {_KEY} % 31', 2)} || '.' || {_pad(f'1 + {_KEY} % 12', 2)} || '.' || CAST(1950 + {_KEY} % 50 AS STRING) || ', телефон +7 900 ' || {_pad(f'{_KEY} % 1000', 3)} || '-' || {_pad(f'{_KEY} % 100', 2)} || '-00.'",
    f"'Карта 0000 0000 0000 ' || {_pad(f'({_KEY} * 31) % 10000', 4)} || ', пин ' || {_pad(f'{_KEY} % 10000', 4)} || ', CVV ' || {_pad(f'{_KEY} % 1000', 3)} || '.'",
    f"'Клиент зарегистрирован по адресу 100000, г. Самара, ул. Мира, д. ' || CAST(1 + {_KEY} % 99 AS STRING) || ', кв. ' || CAST(1 + {_KEY} % 300 AS STRING) || '.'",
    "'Александр Сергеевич Пушкин написал роман.'",
    f"'Код подразделения ' || {_pad(f'{_KEY} % 1000', 3)} || '-000, гражданство: ' || {_pick('Россия,Беларусь,Армения', _KEY)} || '; почта u' || CAST({_KEY} AS STRING) || '@example.com.'",
    f"'ИНН клиента: ' || {_pad(f'({_KEY} * 104729) % 10000000000', 10)} || '. Водительское удостоверение 00 00 ' || {_pad(f'{_KEY} % 1000000', 6)} || '.'",
    "'Сегодня хорошая погода, отделение работает до 18:00.'",
    f"'Серия ' || {_pad(f'{_KEY} % 10000', 4)} || ' № ' || {_pad(f'({_KEY} * 7919) % 1000000', 6)} || ', выдан ' || CAST(1 + {_KEY} % 31 AS STRING) || ' ' || {_pick('января,февраля,апреля,мая', f'{_KEY} / 16')} || ' 2010 УМВД России по г. ' || {_pick('Москва,Санкт-Петербург,Казань', _KEY)} || '.'",
    f"'Держатель: ' || {_pick('ИВАНОВ ИВАН,ПЕТРОВА АННА ИЛЬИНИЧНА,ВОЛКОВ ЛЕВ', _KEY)} || '. Место рождения: г. ' || {_pick('Казань,Пермь,Воронеж', _KEY)} || ', Россия.'",
    f"'Введите пин ' || {_pad(f'{_KEY} % 10000', 4)} || ' для входа.' || chr(10) || chr(10) || 'Карта 0000000000000000 привязана.'",
    f"'Письмо Иванову Ивану Петровичу. Позже Иван Иванов и И.П. Иванов ответили на адрес ' || {_pick('ivan,anna,info', _KEY)} || CAST({_KEY} AS STRING) || '@mail.ru.'",
    f"'Офис: Самара, Мира, ' || CAST(1 + {_KEY} % 50 AS STRING) || '-' || CAST(1 + {_KEY} % 9 AS STRING) || '. Звоните +44 20 7946 0' || {_pad(f'{_KEY} % 1000', 3)} || '.'",
    f"'Клиентка Смирнова Мария Ивановна проживает: г. Пермь, ул. Лесная, дом ' || CAST(1 + {_KEY} % 99 AS STRING) || ', квартира ' || CAST(1 + {_KEY} % 300 AS STRING) || '.'",
    f"'Заявка ' || CAST({_KEY} AS STRING) || ': родился 2001-02-' || {_pad(f'1 + {_KEY} % 31', 2)} || ', ИНН ' || {_pad(f'({_KEY} * 1000003) % 1000000000000', 12)} || '.'",
    f"'Договор 770-' || {_pad(f'{_KEY} % 1000', 3)} || ' от 01.02.2020, сумма ' || CAST({_KEY} % 9000 AS STRING) || ' руб.'",
    f"'Паспорт ' || {_pad(f'{_KEY} % 100', 2)} || ' 10 ' || {_pad(f'({_KEY} * 7919) % 1000000', 6)} || ' утерян, номер бланка 77 ' || {_pad(f'{_KEY} % 100', 2)} || '.'",
    f"'Предъявлено водительское удостоверение ' || {_pad(f'{_KEY} % 10000', 4)} || ' ' || {_pad(f'({_KEY} * 7919) % 1000000', 6)} || ' категории Б, действует.'",
    f"'Тел. 8 (900) ' || {_pad(f'{_KEY} % 1000', 3)} || '-45-67, +7-901-' || {_pad(f'{_KEY} % 1000', 3)} || '-43-21, +7(902)' || {_pad(f'{_KEY} % 1000', 3)} || '2233 и 8903' || {_pad(f'{_KEY} % 1000', 3)} || '5566.'",
    f"'Родился ' || {_pad(f'1 + {_KEY} % 31', 2)} || '/' || {_pad(f'1 + {_KEY} % 12', 2)} || '/1990; паспорт выдан ' || CAST(1 + {_KEY} % 28 AS STRING) || '-11-2010, не ' || CAST(1 + {_KEY} % 28 AS STRING) || '.11/2010.'",
)

#: Texts made from customers' keys; the statement means the same to Spark and DuckDB.
RU_CORPUS_SQL = "SELECT c_custkey AS doc_id, CASE CAST(c_custkey % 20 AS INT) " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END AS text FROM customer"


def ru_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    expression = RU_CORPUS_SQL.removeprefix("SELECT c_custkey AS doc_id, ").removesuffix(" AS text FROM customer")
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.expr(expression).alias("text"))


# consumers' policies. Null types mean all.
POLICIES = (
    ("default", True, True, "partial", None),
    ("chat-assistant", True, True, "synthetic", ("FULL_NAME", "PHONE", "EMAIL", "PASSPORT", "CARD_NUMBER", "CVV", "PIN")),
    ("analytics-pipeline", True, False, "token", None),
)
POLICY_SCHEMA = "consumer_id string, enabled boolean, demask boolean, masking_mode string, mask_types array<string>"


def policies(spark: SparkSession, rows: tuple = POLICIES) -> DataFrame:
    return spark.createDataFrame([(*r[:4], None if r[4] is None else list(r[4])) for r in rows], POLICY_SCHEMA)


def policies_from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Policies of a file with ``default`` and ``consumers``; a missing file means the default that masks all types partially."""
    import os

    import yaml

    known: dict = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            known = yaml.safe_load(f) or {}
    entries = {"default": known.get("default") or {}, **(known.get("consumers") or {})}
    rows = tuple((k, bool(v.get("enabled", True)), bool(v.get("demask", True)), v.get("masking_mode", "partial"), v.get("mask_types")) for k, v in entries.items())
    return policies(spark, rows)


#: Rows of a dimension that are broadcast; one of more is joined by a shuffle.
BROADCAST_ROWS = 100_000


def with_policy(requests: DataFrame, dimension: DataFrame) -> DataFrame:
    """``requests`` with their consumer's policy and ``error_category``: not_found, disabled or null. No consumer means the default."""
    p = dimension.withColumnRenamed("consumer_id", "_consumer")
    if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        p = F.broadcast(p)
    joined = requests.join(p, F.coalesce("consumer_id", F.lit("default")) == F.col("_consumer"), "left")
    return joined.withColumn("error_category", F.when(F.col("_consumer").isNull(), "not_found").when(~F.col("enabled"), "disabled")).drop("_consumer")


#: Fields that must never reach a log or audit sink.
FORBIDDEN = ("payload", "text", "original", "masked_text", "mappings", "occurrences", "value")


def scrubbed(rows: DataFrame) -> DataFrame:
    return rows.drop(*FORBIDDEN)
