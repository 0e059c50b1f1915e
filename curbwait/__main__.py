"""Run the whole analysis: python -m curbwait TRIPS ZONES OUT"""

import argparse

from pyspark.sql import SparkSession

from curbwait.plans.analysis import analyse


def main() -> None:
    parser = argparse.ArgumentParser(prog="curbwait", description=__doc__)
    parser.add_argument("trips", help="trip CSV file or folder")
    parser.add_argument("zones", help="zone CSV file")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--service-area-only", action="store_true")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("curbwait").getOrCreate()
    analyse(spark, given.trips, given.zones, given.out, given.service_area_only).show()


if __name__ == "__main__":
    main()
