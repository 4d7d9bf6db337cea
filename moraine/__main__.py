"""Command line: python -m moraine [-C dir] command ...

    genkey FILE | pubkey FILE
    init [-b SIZE] [-l LABEL] [-p PUBKEY] REPO
    backup [-b SIZE] [-x] [-n] [-v] [--pending] [-e PATTERNS] REPO ROOT
    commit REPO | abort REPO
    restore [-n] [-v] [-S] [-k KEY] [--report] [-o] -d DEST REPO SNAPSHOT
    prune [-v] [-f] [-s SNAPSHOT]... REPO
    cull [-d N] [-w N] [-m N] [-y N] [-v] REPO
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

COMMANDS = ("genkey", "pubkey", "init", "backup", "commit", "abort", "restore", "prune", "cull")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="moraine", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("-C", dest="folder")
    sub = top.add_subparsers(dest="command")
    p = {name: sub.add_parser(name) for name in COMMANDS}
    for name in ("genkey", "pubkey"):
        p[name].add_argument("file")
    for name in COMMANDS[2:]:
        p[name].add_argument("repo")
    p["init"].add_argument("-b", type=int, default=262_144)
    p["init"].add_argument("-l", default="mybackup")
    p["init"].add_argument("-p", help="file with the public key for which blocks are sealed")
    p["backup"].add_argument("root")
    p["backup"].add_argument("-b", type=int)
    p["backup"].add_argument("-x", action="store_true", help="cross devices")
    p["backup"].add_argument("-n", action="store_true", help="dry run")
    p["backup"].add_argument("--pending", action="store_true", help="leave the index pending")
    p["backup"].add_argument("-e", help="file of patterns to exclude")
    p["backup"].add_argument("-v", action="store_true", help="list what is in the snapshot")
    p["restore"].add_argument("snapshot")
    p["restore"].add_argument("-k", help="file with the secret key of sealed blocks")
    p["restore"].add_argument("-S", action="store_true", help="stop before writing if a file is not intact")
    p["restore"].add_argument("--report", action="store_true", help="report files that are not intact by path")
    p["restore"].add_argument("-v", action="store_true", help="list what is restored")
    p["restore"].add_argument("-o", action="store_true", help="set owners")
    p["prune"].add_argument("-f", action="store_true", help="ask the snapshots' filters instead of their entries")
    p["prune"].add_argument("-s", action="append", help="a snapshot to keep; all without any")
    p["restore"].add_argument("-d", help="folder to restore to")
    p["restore"].add_argument("-n", action="store_true", help="list only")
    for name in ("prune", "cull"):
        p[name].add_argument("-v", action="store_true", help="list what is kept")
    for short in "dwmy":
        p["cull"].add_argument(f"-{short}", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    if a.folder:
        os.chdir(a.folder)
    if not a.command:
        top.print_usage()
        return 0
    if a.command in ("genkey", "pubkey"):
        from moraine.functions import crypto

        if a.command == "genkey":
            with os.fdopen(os.open(a.file, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(crypto.generate_key())
        else:
            with open(a.file, "rb") as f:
                sys.stdout.buffer.write(crypto.public_key(f.read(32)))
        return 0
    from moraine.operators.chunk import content_size
    from moraine.plans.snapshots import Config, Repository, write_files

    config = f"{a.repo}/config.json"
    if a.command == "init":
        content_size(a.b)
        recipient = ""
        if a.p:
            with open(a.p, "rb") as f:
                recipient = f.read(32).hex()
        os.makedirs(a.repo, exist_ok=True)
        if os.listdir(a.repo):
            print("the folder is not empty", file=sys.stderr)
            return 1
        with open(config, "x") as f:
            json.dump(asdict(Config(label=a.l, block_size=a.b, recipient=recipient)), f)
        os.mkdir(f"{a.repo}/devices")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with open(config) as f:
        settings = json.load(f)
    if a.command == "backup":
        settings |= {"cross_devices": a.x} | ({"block_size": a.b} if a.b else {})
    repo = Repository(spark, os.path.abspath(a.repo), Config(**settings))
    if a.command == "backup":
        from moraine.sources.files import InodeSource, contents, devices

        spark.dataSource.register(InodeSource)
        files = spark.read.format("inodes").load(os.path.abspath(a.root))
        patterns = open(a.e).read().split("\n") if a.e else None
        done = repo.backup(files, contents(spark, a.root), devices(spark, f"{a.repo}/devices"), exclude=patterns, commit=not a.pending, dry_run=a.n)
        if a.v and not a.n:
            for r in repo.listing(done["snapshot"]).toLocalIterator():
                print(r["path"])
        print(json.dumps(done))
    elif a.command in ("commit", "abort"):
        getattr(repo, a.command)()
    elif a.command == "restore":
        if a.n or a.v:
            for r in repo.listing(a.snapshot).toLocalIterator():
                print(r["digest"], r["path"])
        if a.n:
            return 0
        secret = None
        if a.k:
            with open(a.k, "rb") as f:
                secret = f.read(32)
        restored = repo.restore(a.snapshot, secret)
        if a.S or a.report:
            damaged = [r["path"] for r in restored.where("not is_intact").select("path").toLocalIterator()]
            for path in damaged:
                print(f"not intact: {path}", file=sys.stderr)
            if a.S and damaged:
                return 1
        return int(write_files(restored, os.path.abspath(a.d), owners=a.o) > 0)
    elif a.command == "prune":
        for r in repo.prune(a.s, invert=a.v, filters=a.f).toLocalIterator():
            print(f"objects/{r['id'][:3]}/{r['id']}")
    else:
        rules = {"days": a.d, "weeks": a.w, "months": a.m, "years": a.y}
        for r in repo.cull(rules, invert=a.v).orderBy("ts").toLocalIterator():
            print(r["id"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
