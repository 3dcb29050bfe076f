"""The grouping run: folder in, named plan, files and manifest out."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import pixels
from kinfold.functions.vectors import fused
from kinfold.operators.embed import Embedder, OnnxEmbedder, infer
from kinfold.operators.linkage import average_link_clusters, complete_link, representatives, require_partition
from kinfold.operators.naming import named_plan
from kinfold.operators.pairs import duplicate_edges, require_features
from kinfold.operators.storage import scratch, written
from kinfold.options import GroupingOptions, UsageError
from kinfold.sources import decode as decoding
from kinfold.sources.discover import discover
from kinfold.sources.sink import PlanRow, settled, preflight, write_outputs

PREPARED = "rel_path string, ok boolean, reason string, crop binary, histogram array<float>, dhash long, aspect_ratio double, thumb binary"


def prepare_image(image) -> dict:
    """Everything that is kept of one decoded image."""
    bits = pixels.dhash(image)
    return {"crop": pixels.crop(image).tobytes(), "histogram": pixels.histogram(image).tolist(), "dhash": bits - (1 << 64) if bits >> 63 else bits, "aspect_ratio": image.shape[1] / image.shape[0], "thumb": pixels.thumbnail(image).tobytes()}


def _outcome(rel_path: str, load: Callable) -> dict:
    try:
        return {"rel_path": rel_path, "ok": True, "reason": None} | prepare_image(load())
    except (OSError, ValueError, SyntaxError) as error:
        return {"rel_path": rel_path, "ok": False, "reason": f"unreadable image: {error}", "crop": None, "histogram": None, "dhash": None, "aspect_ratio": None, "thumb": None}


def prepared(files: DataFrame, attempts=None) -> DataFrame:
    """One decode of each file: features, or the reason why it is unreadable.
    ``attempts`` is an accumulator of the files tried."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 16):
                part = pdf.iloc[lo : lo + 16]
                if attempts is not None:
                    attempts.add(len(part))
                yield pd.DataFrame([_outcome(r, lambda a=a: decoding.decode(Path(a).read_bytes())) for r, a in zip(part.rel_path, part.abs_path, strict=True)])

    return files.select("rel_path", "abs_path").mapInPandas(run, PREPARED)


def jvm_prepared(spark: SparkSession, files: DataFrame) -> DataFrame:
    """JPEG and TIFF files by the JVM's reader, where no library is installed."""
    rows = [(r.rel_path, Path(r.abs_path).as_uri(), r.abs_path) for r in files.collect()]
    seen = [r for r in rows if Path(r[2]).name[0] not in "._"]
    if not seen:
        return spark.createDataFrame([], PREPARED)
    images = spark.read.format("image").load([u for _, u, _ in seen]).select("image.*")
    names = spark.createDataFrame([(r, u.replace("file:///", "file:/"), a) for r, u, a in rows], "rel_path string, origin string, abs_path string")
    joined = names.join(images.withColumn("origin", F.regexp_replace("origin", "^file:/+", "file:/")), "origin", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                def load(r=r):
                    if r.data is None:
                        raise ValueError("no decoder for this format")
                    head = Path(r.abs_path).read_bytes()
                    turn = decoding.jpeg_orientation(head) if head[:2] == b"\xff\xd8" else decoding.exif_orientation(head)
                    return decoding.from_jvm(r.data, int(r.width), int(r.height), int(r.nChannels), turn)

                yield pd.DataFrame([_outcome(r.rel_path, load)])

    return joined.mapInPandas(run, PREPARED)


def _has_library() -> bool:
    try:
        import PIL  # noqa: F401
    except ImportError:
        return False
    return True


def extract(image, session, alpha: float = 0.80) -> dict:
    """The features of one decoded image, in arrays and numbers, without Spark."""
    found = prepare_image(image)
    crop = np.frombuffer(found.pop("crop"), np.uint8).reshape(pixels.CROP, pixels.CROP, 3)
    content, colour = infer(session, pixels.model_input(crop))[0], np.asarray(found["histogram"], dtype=np.float32)
    weighed = np.concatenate([content * np.float32(math.sqrt(alpha)), colour * np.float32(math.sqrt(1.0 - alpha))])
    return found | {"embedding": content, "histogram": colour, "v": pixels.unit(weighed)}


def group_features(features: DataFrame, options: GroupingOptions, done: Callable[[str], None] = lambda step: None) -> DataFrame:
    """The named plan of rows with rel_path, v, dhash, aspect_ratio and thumb."""
    require_features(features)
    groups = written(complete_link(features, duplicate_edges(features)), "duplicates")
    require_partition(features, groups)
    done("duplicates")
    rows = features.select("rel_path", "v").join(groups, "rel_path")
    reps = representatives(rows)
    if groups.select("dup_group").distinct().limit(2).count() == 1:
        clusters = reps.select("dup_group", F.col("dup_group").alias("cluster_key"))
    else:
        clusters = written(average_link_clusters(written(reps, "representatives"), options.threshold), "clustered")
    done("clusters")
    return named_plan(rows.join(clusters, "dup_group").select("rel_path", "v", "cluster_key"))


#: Steps of the last stage, which have equal shares of its progress.
STEPS = ("fusion", "duplicates", "clusters", "names", "preflight", "output")


class Steps:
    """Turns work within the steps of a stage into its progress."""

    def __init__(self, report: Callable[[int, int], None]) -> None:
        self.report = report

    def done(self, step: str) -> None:
        """A whole step."""
        self.report(STEPS.index(step) + 1, len(STEPS))

    def within(self, step: str) -> Callable[[int, int], None]:
        """Counts of done and all work within a step."""
        return lambda done, total: self.report(STEPS.index(step) * total + done, len(STEPS) * total) if total else None


@contextmanager
def watched(spark: SparkSession, report: Callable[[int, int], None], every: float = 0.5):
    """Report the done and all tasks of the stages that run meanwhile."""
    over = threading.Event()

    def look() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not over.wait(every):
            found = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x is not None]
            if found:
                report(sum(x.numCompletedTasks for x in found), sum(x.numTasks for x in found))

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def run(spark: SparkSession, source: Path, destination: Path, options: GroupingOptions | None = None, manifest: Path | None = None, embedder: Embedder | None = None, stage: Callable[[str], None] = lambda _: None, before_summary: Callable[[list], bool] | None = None, report: Callable[[int, int], None] = lambda done, total: None, on_attempt: Callable[[int, int], None] = lambda tried, files: None) -> dict:
    """Group a folder's images; counts of what was read, clustered and skipped.

    The order of checks is part of the contract: paths, listing, size, decoding,
    emptiness, model, inference, grouping, names, preflight, writing. ``report`` gets
    the done and all work of a stage, ``on_attempt`` the files tried so far.
    """
    with scratch(spark):
        return _run(spark, source, destination, options or GroupingOptions(), manifest, embedder or OnnxEmbedder(), stage, before_summary, report, on_attempt)


def _run(spark, source, destination, options, manifest, embedder, stage, before_summary, report, on_attempt) -> dict:
    places = settled(source, destination, manifest)
    stage("Reading images")
    files, skipped = discover(spark, places.source, options.recursive)
    n = files.count()
    if options.max_files is not None and n > options.max_files:
        raise UsageError(f"{n} files have the extensions of images; a run is tested with at most {options.max_files} of them, readable or not")
    attempts = spark.sparkContext.accumulator(0)

    def tried(done: int, total: int) -> None:
        on_attempt(attempts.value, n)
        report(attempts.value, n)

    through_jvm = F.lower("ext").isin(".jpg", ".jpeg", ".tif", ".tiff") & F.lit(not _has_library())
    decoded = prepared(files.where(~through_jvm), attempts).unionByName(jvm_prepared(spark, files.where(through_jvm)))
    with watched(spark, tried):
        decoded = written(decoded, "prepared")
    on_attempt(n, n)
    good = decoded.where("ok")
    skipped = skipped.unionByName(decoded.where("not ok").select("rel_path", "reason"))
    if good.limit(1).count() == 0:
        raise UsageError("none of the source's images can be read")
    stage("Extracting features")
    embedder.check()
    with watched(spark, report):
        embedded = written(embedder.embed(good).drop("crop", "ok", "reason"), "embedded")
    stage("Grouping and writing")
    steps = Steps(report)
    features = written(embedded.withColumn("v", fused(F.col("embedding"), F.col("histogram"), options.alpha)), "features")
    steps.done("fusion")
    rows = group_features(features, options, steps.done).orderBy("cluster", "index").collect()  # a plan is written row by row
    plan = [PlanRow(**r.asDict()) for r in rows]
    skips = skipped.orderBy("rel_path").collect()
    steps.done("names")
    preflight(places, plan, steps.within("preflight"))
    write_outputs(places, plan, skips, steps.within("output"))
    if before_summary:
        before_summary(skips)
    return {"images": len(plan), "clusters": len({r.cluster for r in plan}), "skipped": len(skips)}
