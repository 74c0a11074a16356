"""Process definitions (name, description), read from a JSON array file in file order."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Our own definitions for the adapter's process names. One differs only in case
# (matched case-insensitively), "Vendor registration" has none, and "Travel booking" matches
# nothing observed.
DEFINITIONS = [
    ("Quarterly budget review and approval", "Finance collects departmental budgets, reviews variances and signs off the plan for the quarter."),
    ("Quarterly Budget Review and Archive", "Finance files the reviewed quarterly budget with its supporting documents for audit."),
    ("Invoice processing", "Accounts payable receives an invoice, matches it to the purchase order and schedules the payment."),
    ("Employee onboarding", "HR prepares accounts, equipment and paperwork for a new hire and books the first-week sessions."),
    ("Contract renewal", "Legal reviews an expiring contract, negotiates changed terms and executes the renewal."),
    ("Expense report submission", "An employee files receipts, a manager approves them and finance reimburses the amount."),
    ("Travel booking", "An employee requests a trip and the travel desk books transport and lodging."),
]

SCHEMA = "def_pos int, name string, description string"


def builtin_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(DEFINITIONS)], SCHEMA)


def read_definitions(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON array of {name, description}; None when the file cannot be read (callers then use
    the text 'No process definitions available.'). File order is kept as def_pos."""
    try:
        raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("name string, description string").json(path)
        raw.write.format("noop").mode("overwrite").save()   # reads are lazy: parse the small file now, so that a fault shows here
        # A multi-line JSON array is one record per element, in file order within the single file.
        return raw.select(F.monotonically_increasing_id().cast("int").alias("def_pos"), "name", "description")
    except (PySparkException, Py4JJavaError):  # an unreadable file means "no definitions", as in the reference
        return None
