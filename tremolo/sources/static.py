"""Static dimensions: the incidents log, cause explanations and fixed answers.

These are small literal tables kept as DataFrames so that they join like any other
table (broadcast, since their size is fixed by the literals below).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

# The incidents log (date, incidents, root cause).
INCIDENTS = [
    ("2023-02-01", 1, "Process based alert"),
    ("2023-04-26", 25, "Bearing fault"),
    ("2023-04-27", 78, "Bearing fault"),
    ("2023-04-28", 42, "Bearing fault"),
    ("2023-04-29", 29, "Bearing fault"),
    ("2023-04-30", 23, "Bearing fault"),
    ("2023-05-02", 1, "Bearing fault"),
    ("2023-05-03", 4, "Bearing fault"),
    ("2023-07-03", 1, "Process based alert"),
    ("2023-10-04", 2, "Balance fault"),
    ("2023-10-05", 3, "Balance fault"),
    ("2023-10-06", 15, "Balance fault"),
    ("2023-12-10", 1, "Process based alert"),
]

# Explanation per root cause (defined but unused in the reference).
EXPLANATIONS = [
    ("Process based alert",
     "Yanlış sensör kalibrasyonu veya ani değişimler. Süreçte durma, bakım artışı."),
    ("Bearing fault", "Yağsızlık, kir, hizasızlık. Titreşim artışı, rulman hasarı."),
    ("Balance fault", "Rotor dengesizliği. Sallanma, yorulma, rezonans."),
]

# Answers that do not depend on the data (catalogue entries 30 and 31,
# counting from 0).
STATIC_ANSWERS = [
    (30, "Makinenin performansını artırmak için düzenli bakım önerilir, "
         "sensör kalibrasyonu yapılmalı ve çalışma ortamı koşulları izlenmelidir."),
    (31, "Titreşim performansını etkileyebilecek başlıca faktörler:\n"
         "- Fan yataklarının aşınması\n"
         "- Balans bozulmaları\n"
         "- Mekanik gevşemeler veya darbe etkileri\n"
         "Bu unsurlar düzenli kontrol edilmelidir."),
]


def incidents_df(spark: SparkSession) -> DataFrame:
    """SRC6: the incidents log as (date date, incidents long, root_cause string)."""
    rows = [(_dt.date.fromisoformat(d), n, c) for d, n, c in INCIDENTS]
    return spark.createDataFrame(rows, "date date, incidents long, root_cause string")


def explanations_df(spark: SparkSession) -> DataFrame:
    """SRC7e: root_cause -> explanation."""
    return spark.createDataFrame(EXPLANATIONS, "root_cause string, explanation string")


def static_answers_df(spark: SparkSession) -> DataFrame:
    """SRC7c / SRC7d: intent_id -> fixed answer text."""
    return spark.createDataFrame(STATIC_ANSWERS, "intent_id int, answer string")
