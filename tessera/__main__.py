"""``python -m tessera QUERY FOLDER [OUTPUT]``: runs a registered query over a folder of tables; without OUTPUT its first rows are shown, else it is written as Parquet."""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from tessera.plans import registry

    queries = registry.queries()
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("query", choices=sorted(queries), metavar="QUERY")
    parser.add_argument("folder", metavar="FOLDER")
    parser.add_argument("output", nargs="?", metavar="OUTPUT")
    given = parser.parse_args(arguments)
    found = queries[given.query](SparkSession.builder.getOrCreate(), given.folder)
    found.write.parquet(given.output) if given.output else found.show()


if __name__ == "__main__":
    main()
