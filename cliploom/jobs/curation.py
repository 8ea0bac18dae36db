"""One curation pass as a job: read the set, curate it, write what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom.functions.shared import stored
from cliploom.operators.curation import Pass, curation_pass
from cliploom.operators.reconcile import Repaired, repair_entries
from cliploom.sources import media

LEDGER = "media_path string, source_file string, chunk_idx int, reason string"


def read_set(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The newest manifest and the whole ledger under root; either may be empty."""
    return media.current_entries(spark, root), media.read_rejections(spark, f"{root}/ledger", LEDGER)


def curate(spark: SparkSession, root: str, clips: DataFrame, grid: DataFrame, matches: DataFrame, sightings: DataFrame, cast: DataFrame, max_samples: int, **how) -> Pass:
    """A curation_pass() over the set under root, whose rejections are appended to the ledger and whose manifest becomes the newest version.

    The ledger is written first: after a crash in between, accepted clips are open slots again, and no
    rejected one is. A second call changes neither.
    """
    entries, ledger = read_set(spark, root)
    done = curation_pass(entries, ledger, clips, grid, matches, sightings, cast, max_samples, **how)
    if not done.rejections.isEmpty():
        media.append_rejections(done.rejections, f"{root}/ledger")
    media.write_entries(done.entries, root)
    return done


def repair(spark: SparkSession, root: str, clips: DataFrame, files: DataFrame, artifacts: DataFrame, limit: int = 128) -> Repaired:
    """Repair the set under root: the ledger gets what went, and the manifest a new version if anything differs; the version before stays as its backup.

    Who has written meanwhile is not overwritten: that is a Conflict. Artifacts in `drop` are for the caller to delete.
    """
    version = media.current_version(spark, root)
    entries = media.current_entries(spark, root, version)
    done = repair_entries(entries, clips, files, artifacts, limit)
    whole = stored(done.entries, "repaired")
    gone = stored(done.rejections, "orphans")
    changed = not gone.isEmpty() or not done.drop.isEmpty() or whole.count() != entries.count()
    if changed:
        if not gone.isEmpty():
            media.append_rejections(gone, f"{root}/ledger")
        media.write_entries(whole, root, based_on=version)
    return Repaired(whole, gone, done.drop)
