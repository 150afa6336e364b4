import sys

from pyspark.sql import SparkSession

from wickerlane.cli import run

run(SparkSession.builder.appName("wickerlane").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:])
