"""Job entry: one run of the plan, or one every so many hours.

    python -m lectern.plans.job --store DIR [--topics a,b] [--num-episodes 3] [--every HOURS]
"""

from __future__ import annotations

import argparse
import datetime as dt
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.plans.service import Service
from lectern.sources.catalog import catalog
from lectern.sources.config import listed, settings
from lectern.sources.store import Store

#: Fixed value: hours between scheduled runs.
HOURS = 24


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Discover papers and write briefs.")
    parser.add_argument("--store", required=True, help="folder of the store")
    parser.add_argument("--topics", default="", help="topics, set apart by commas")
    parser.add_argument("--num-episodes", type=int, default=3, help="briefs to write")
    parser.add_argument("--every", type=float, default=0, help=f"hours between runs, say {HOURS}; one run if 0")
    return parser.parse_args(given)


def demo(spark: SparkSession):
    """Candidates from the catalogue, whatever the topics and the window."""
    rows = catalog(spark).withColumn("published", F.col("published_at").cast("timestamp").cast("timestamp_ntz")).withColumn("ord", F.monotonically_increasing_id())
    return lambda topics, days: rows


def due(last: dt.datetime | None, now: dt.datetime, hours: float = HOURS) -> bool:
    return last is None or now - last >= dt.timedelta(hours=hours)


def scheduled(run: Callable[[dt.datetime], object], hours: float, clock: Callable[[], dt.datetime], sleep: Callable[[float], None], turns: int | None = None) -> int:
    """Call ``run`` whenever it is due; a run that fails is tried again when next due.  ``turns`` bounds the checks."""
    last, done = None, 0
    while turns is None or turns > 0:
        now = clock()
        if due(last, now, hours):
            last = now
            try:
                run(now)
                done += 1
            except Exception as e:  # noqa: BLE001  the schedule outlives a failed run
                print(f"run failed: {e}")
        sleep(60.0)
        turns = None if turns is None else turns - 1
    return done


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(given)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    config = replace(settings(), episodes=args.num_episodes)
    service = Service(Store(spark, args.store), config, demo(spark))
    topics = listed("TOPICS", config.topics, {"TOPICS": args.topics})
    if args.topics.strip() or not service.topics():
        service.set_topics(topics)

    def run(now: dt.datetime) -> None:
        before = service.store.read("episodes").select("id")
        held = service.store.staged(before)
        service.run(now)
        new = service.store.read("episodes").join(held, "id", "left_anti")
        print("Run complete.")
        for r in new.orderBy("title").limit(args.num_episodes).collect():
            print(f"- {r['title']} ({r['duration_secs']}s, {r['qa_status']})")
        service.store.unstage(held)

    clock = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)
    if args.every:
        scheduled(run, args.every, clock, time.sleep)
    else:
        run(clock())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
