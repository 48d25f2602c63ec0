"""Commands. Exit codes: 0 fine, 1 invalid or failed, 2 usage or a missing file."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.errors import PySparkException

from tidemark.plans import spec as specs
from tidemark.plans.contract import INTERACTIONS


def instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise argparse.ArgumentTypeError("a time needs a zone")
    return at.astimezone(timezone.utc)


def session():
    from pyspark.sql import SparkSession

    from tidemark.session import configured

    spark = configured(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _show(value) -> None:
    print(json.dumps(value, default=str, sort_keys=True))


def validate(args) -> int:
    found = specs.load(args.spec, INTERACTIONS)
    kind = specs.LabelSpec if args.command == "validate-label-spec" else specs.FeatureSpec
    if not isinstance(found, kind):
        raise ValueError(f"{args.spec} is no {kind.__name__}")
    print(f"{found.name} v{found.version} is valid")
    return 0


def test_spec(args) -> int:
    from tidemark.operators.features import point_in_time
    from tidemark.sources import files

    spark, found = session(), specs.load(args.spec, INTERACTIONS)
    entity = dict(x.split("=", 1) for x in args.entity)
    if set(entity) != set(found.keys):
        raise ValueError(f"the entity needs {found.keys}")
    obs = spark.createDataFrame([(*(entity[k] for k in found.keys), args.at)], ", ".join([*(f"{k} string" for k in found.keys), "observation_time timestamp"]))
    row = point_in_time(files.read_events_jsonl(spark, args.events, INTERACTIONS), obs, found, INTERACTIONS).first()
    _show({name: row[name] for name in found.outputs})
    return 0


def backfill_spec(args) -> int:
    from tidemark.operators.features import point_in_time
    from tidemark.sources import files

    spark, found = session(), specs.load(args.spec, INTERACTIONS)
    obs = files.read_observations_jsonl(spark, args.observations, found.keys)
    files.write_new(point_in_time(files.read_events_jsonl(spark, args.events, INTERACTIONS), obs, found, INTERACTIONS), args.output)
    return 0


def build_dataset(args) -> int:
    from pyspark.sql import functions as F

    from tidemark.operators import dataset
    from tidemark.sources import files

    spark = session()
    features = [specs.load(p, INTERACTIONS) for p in args.features]
    target = specs.load(args.label, INTERACTIONS)
    if (args.mode == "published_as_of") != bool(args.history):
        raise ValueError("histories belong to published_as_of, and it needs them")
    histories = {n: files.read_parquet(spark, p) for n, p in (x.split("=", 1) for x in args.history or ())}
    missing = {f.name for f in features} - set(histories) if args.history else set()
    if missing:
        raise ValueError(f"no history for {sorted(missing)}")
    events = files.read_events_jsonl(spark, args.events, INTERACTIONS)
    obs = files.read_observations_jsonl(spark, args.observations, target.keys)
    out, gone = dataset.assemble(events, obs, features, target, INTERACTIONS, F.lit(args.data_end), args.mode, histories)
    _show(dataset.build(out, gone, args.output, args.mode, {s.name: s.version for s in [*features, target]}))
    return 0


def generate(args) -> int:
    from tidemark.sources import files
    from tidemark.sources.synthetic import interactions

    files.write_new(interactions(session(), args.events, args.users, args.items, args.start, args.days, args.seed), f"{args.output}/events.parquet")
    return 0


def compute(args) -> int:
    from tidemark.plans.jobs import backfill

    _show(backfill(session(), args.sources, args.output, args.first, args.last or args.first, args.window_days))
    return 0


def check_freshness(args) -> int:
    from tidemark.operators.quality import freshness
    from tidemark.plans.jobs import VIEWS, newest, stored_view

    spark, good = session(), True
    for view in VIEWS.values():
        ok, lag = freshness(newest(stored_view(spark, args.output, view)), args.now, args.max_lag_days)
        _show({"view": view.name, "fresh": ok, "lag_days": lag})
        good &= ok
    return 0 if good else 1


def publish(args) -> int:
    from tidemark.plans.jobs import publish as run

    start = None if args.command == "materialize-incremental" else args.start
    _show(run(session(), args.output, args.online, start, args.end, args.now, args.max_lag_days))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, **options):
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        for option, more in options.items():
            p.add_argument(f"--{option.replace('_', '-')}" if not more.pop("place", False) else option, **more)
        return p

    need, now = {"required": True}, {"type": instant, "default": datetime.now(timezone.utc)}
    lag = {"type": float, "default": 2.0}
    spec = {"place": True}
    command("validate-spec", validate, spec={**spec})
    command("validate-label-spec", validate, spec={**spec})
    command("test-spec", test_spec, spec={**spec}, events={**need}, entity={**need, "nargs": "+"}, at={**need, "type": instant})
    command("backfill-spec", backfill_spec, spec={**spec}, events={**need}, observations={**need}, output={**need})
    command(
        "build-training-dataset", build_dataset, mode={**need, "choices": ["event_time", "published_as_of"]}, features={**need, "nargs": "+"}, label={**need},
        events={**need}, observations={**need}, data_end={**need, "type": instant}, output={**need}, history={"nargs": "+"},
    )
    command(
        "generate", generate, output={**need}, events={"type": int, "default": 10_000}, users={"type": int, "default": 500}, items={"type": int, "default": 250},
        start={"type": instant, "default": datetime(2026, 1, 1, tzinfo=timezone.utc)}, days={"type": int, "default": 30}, seed={"type": int, "default": 1},
    )
    day = {"type": date.fromisoformat}
    for name in ("compute-features", "backfill"):
        last = {"last": {**day, "required": name == "backfill"}}
        command(name, compute, sources={**need}, output={**need}, first={**day, **need}, window_days={"type": int, "default": 30}, **last)
    command("check-freshness", check_freshness, output={**need}, now={**now}, max_lag_days={**lag})
    for name in ("materialize", "materialize-incremental"):
        first = {"start": {"type": instant, "required": True}} if name == "materialize" else {}
        command(name, publish, output={**need}, online={**need}, end={**need, "type": instant}, now={**now}, max_lag_days={**lag}, **first)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    for name in ("spec", "label", "events", "observations"):
        path = getattr(args, name, None)
        if isinstance(path, str) and "://" not in path and not Path(path).exists():
            print(f"{path} is not there", file=sys.stderr)
            return 2
    try:
        return args.run(args)
    except (ValueError, RuntimeError, OSError, PySparkException) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
