import sys

from pyspark.sql import SparkSession

from ferrule.store import main

if len(sys.argv) < 3:
    raise SystemExit(main.__doc__)
print(main(sys.argv[1:], SparkSession.builder.getOrCreate()))
