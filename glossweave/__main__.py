"""The command line: `python -m glossweave -i FOLDER` with the steps to take."""

from __future__ import annotations

import argparse


def parsed(words: list[str] | None = None) -> tuple[str, dict]:
    """The store's folder and the steps that are asked for."""
    p = argparse.ArgumentParser(prog="glossweave", description="Steps take effect in this order, whatever that of the options.")
    p.add_argument("-i", "--input", required=True, metavar="FOLDER", help="the store")
    p.add_argument("-a", "--add", nargs="+", metavar="PATH", help="register files as sources")
    p.add_argument("-d", "--delete", nargs="+", metavar="KEY", help="remove sources and what came of them")
    for flag, name, text in (("-f", "fetch", "read the sources' files"), ("-c", "config", "take up the prefixes that they declare"), ("-b", "build", "make enums and values of them"), ("-l", "lookup", "count the values of their enums")):
        p.add_argument(flag, f"--{name}", nargs="*", metavar="KEY", help=f"{text}; all without keys")
    p.add_argument("-s", "--sssom", nargs="*", metavar="PREDICATE", help="apply mappings; all without predicates")
    p.add_argument("-r", "--report", action="store_true", default=None, help="list the enums")
    p.add_argument("--search", metavar="TEXT", help="look for terms, separated by semicolons")
    p.add_argument("--format", choices=["text", "tsv", "markdown"], default="text")
    p.add_argument("--translate", metavar="KEY", help="translate the titles of a source, where a provider is set")
    p.add_argument("--lang", default="fr")
    given = vars(p.parse_args(words))
    folder = given.pop("input")
    return folder, {k: v for k, v in given.items() if v is not None}


def main() -> None:
    from pyspark.sql import SparkSession

    from .plans import store

    folder, asked = parsed()
    spark = SparkSession.builder.appName("glossweave").getOrCreate()
    for lines in store.run(store.Store(spark, folder), asked).values():
        for row in lines.toLocalIterator():
            print(row.line)


if __name__ == "__main__":
    main()
