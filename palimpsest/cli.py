"""Command line: ``python -m palimpsest.cli run|policy ...``.

Exit codes: 0 publishable, 1 error, 2 wrong call, 3 the policy waits for approval, 4 not publishable.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from palimpsest.functions.prf import Secret
from palimpsest.lifecycle import Database, analyse, execute, load_approvals, publish, save_policy
from palimpsest.plans.rulepack import RulePack, default_pack
from palimpsest.sources.catalog import Catalog, read
from palimpsest.sources.introspect import Constraints


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("command", choices=["policy", "run"])
    parser.add_argument("--catalog", required=True, help="JSON with sources and sinks")
    parser.add_argument("--source", required=True)
    parser.add_argument("--sink")
    parser.add_argument("--tables", required=True, help="names, separated by commas")
    parser.add_argument("--constraints", help="JSON: sidecar of each table")
    parser.add_argument("--pack", help="rule pack in JSON; the default one otherwise")
    parser.add_argument("--approvals")
    parser.add_argument("--secret", help="file with the secret")
    parser.add_argument("--policy", default="policy.json", help="where the policy is written")
    parser.add_argument("--publish", help="area of recipients")
    try:
        a = parser.parse_args(args)
    except SystemExit:
        return 2
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    try:
        catalog = Catalog.load(_text(a.catalog))
        pack = RulePack.from_json(_text(a.pack)) if a.pack else default_pack()
        sidecars = {t: Constraints(**c) for t, c in json.loads(_text(a.constraints)).items()} if a.constraints else {}
        source = catalog.source(a.source)
        db = Database({t: read(spark, source, t) for t in a.tables.split(",")}, sidecars)
        policy = analyse(db, pack, approvals=load_approvals(_text(a.approvals)) if a.approvals else None)
        save_policy(policy, a.policy)
        if a.command == "policy" or policy.problems():
            print("\n".join(policy.problems()))
            return 3 if policy.problems() else 0
        run = execute(db, policy, pack, Secret.from_file(a.secret), catalog.sink(a.sink))
        print(run.passport.to_markdown())
        if not run.passport.publishable:
            return 4
        if a.publish:
            print(publish(run, a.publish))
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
