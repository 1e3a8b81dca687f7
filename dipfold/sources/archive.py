"""Archives of light curves: files ``<star>_<product>.csv`` or ``<star>_<product>@<seconds>.csv`` (the cadence) with lines ``time,flux``.

:func:`read_archive` reads them with Spark's own text reader from any store that Spark reaches: listing, splitting and retries are Spark's.
:class:`LightCurveArchive` is a batch data source for a mounted archive that has to be asked gently, star by star; :func:`opened` sets it up.

Filters on ``star_id`` and ``exptime_s`` are pushed to the source: with a list of stars only their files are looked for and opened. Folders are listed by
the tasks, not by the driver. Requests of all tasks together keep a least gap: time is cut into slots of that length, and a task claims the next free slot
by a file in a shared folder that can be made only once. Attempts are repeated with a doubling pause. With a cache folder, files are
copied there first; a copy that cannot be parsed is evicted and fetched once more. What cannot be read all the same gives a row with its error
instead of ending the job.
"""

from __future__ import annotations

import csv
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Attempts at one file, first pause between them (it doubles), least time between two requests, stars for each task.
ATTEMPTS, FIRST_PAUSE_S, GAP_S, STARS_PER_TASK = 3, 5.0, 1.5, 25
#: Tasks that list an archive of which no star is named.
TASKS = 64


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``star_id, product_id, exptime_s, t_bkjd, flux, error`` of all files under ``path``; a line that cannot be read is a row with its error."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    star, product = F.regexp_extract(name, r"^([0-9]+)_", 1).try_cast("long"), F.regexp_extract(name, r"^[0-9]+_(.*?)(@[0-9.]+)?\.csv$", 1)
    exptime = F.regexp_extract(name, r"@([0-9.]+)\.csv$", 1).try_cast("double")
    parts = F.split("value", ",")
    t, flux = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1))
    bad = t.isNull() | (F.size(parts) != 2) | ((flux != "") & flux.try_cast("double").isNull())
    error = F.when(bad, F.concat(F.lit("ValueError: "), F.substring("value", 1, 280)))
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).where("value <> ''")
    return lines.select(star.alias("star_id"), product.alias("product_id"), exptime.alias("exptime_s"), F.when(~bad, t).alias("t_bkjd"), F.when(~bad, flux.try_cast("double")).alias("flux"), error.alias("error"))


def evict_star(spark: SparkSession, path: str, star: int) -> int:
    """Delete the cached files of one star, told by the whole number before the first underscore; how many there were."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    mine = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().split("_")[0].lstrip("0") == str(star)] if fs.exists(root) else []
    return sum(bool(fs.delete(p, True)) for p in mine)


class Lease:
    """Leave to ask, at most once in ``gap`` seconds over all tasks that share ``folder``."""

    def __init__(self, folder: str, gap: float):
        self.folder, self.gap = folder, gap
        os.makedirs(folder, exist_ok=True)

    def wait(self) -> None:
        slot = int(time.time() / self.gap) + 1
        while not self._claim(slot):
            slot += 1
        time.sleep(max(0.0, slot * self.gap - time.time()))

    def _claim(self, slot: int) -> bool:
        try:
            os.close(os.open(os.path.join(self.folder, str(slot)), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        for old in os.listdir(self.folder):
            if old.isdigit() and int(old) < slot - 1000:
                try:
                    os.remove(os.path.join(self.folder, old))
                except FileNotFoundError:
                    pass  # another task was first
        return True


class _Part(InputPartition):
    """Some stars by name, or one share of all of them."""

    def __init__(self, stars: list[int] | None, share: int = 0):
        super().__init__(share)
        self.stars, self.share = stars, share


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.cache, self.lease_at = options["path"], options.get("cache"), options.get("lease")
        self.pause, self.gap, self.tasks = float(options.get("pause_s", FIRST_PAUSE_S)), float(options.get("gap_s", GAP_S)), int(options.get("tasks", TASKS))
        self.stars: set[int] | None = None
        self.exptimes: set[float] | None = None
        self.last = float("-inf")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("star_id",):
                self.stars = wanted if self.stars is None else self.stars & wanted
            elif wanted is not None and f.attribute == ("exptime_s",):
                self.exptimes = wanted if self.exptimes is None else self.exptimes & wanted
            else:
                yield f

    def partitions(self) -> list[_Part]:
        if self.stars is None:
            return [_Part(None, k) for k in range(self.tasks)]
        stars = sorted(s for s in self.stars if s is not None)
        return [_Part(stars[k : k + STARS_PER_TASK], k) for k in range(0, len(stars), STARS_PER_TASK)]

    def _mine(self, part: _Part) -> Iterator[tuple[str, int, str, float | None]]:
        """Name, star, product and cadence of the files of a partition."""
        stars = None if part.stars is None else set(part.stars)
        with os.scandir(self.path) as files:
            names = sorted(f.name for f in files if f.name.endswith(".csv") and f.name.partition("_")[0].isdigit())
        for name in names:
            star, _, rest = name[: -len(".csv")].partition("_")
            product, _, seconds = rest.partition("@")
            exptime = float(seconds) if seconds else None
            chosen = int(star) in stars if stars is not None else crc32(star.encode()) % self.tasks == part.share
            if chosen and (self.exptimes is None or exptime in self.exptimes):
                yield name, int(star), product, exptime

    def _ask(self) -> None:
        """Wait until the next request may be made."""
        if self.lease_at:
            Lease(self.lease_at, self.gap).wait()
        else:
            time.sleep(max(0.0, self.last + self.gap - time.monotonic()))  # no two requests of a task closer than the gap
        self.last = time.monotonic()

    def _local(self, name: str) -> tuple[str, bool]:
        """Where to read a file, and whether that is a copy that was there before."""
        source = os.path.join(self.path, name)
        if not self.cache:
            self._ask()
            return source, False
        copy = os.path.join(self.cache, name)
        if os.path.exists(copy):
            return copy, True
        self._ask()
        os.makedirs(self.cache, exist_ok=True)
        aside = f"{copy}.{uuid.uuid4().hex}"
        shutil.copyfile(source, aside)
        os.replace(aside, copy)
        return copy, False

    def read(self, partition: _Part) -> Iterator[tuple]:
        for name, star, product, exptime in self._mine(partition):
            yield from self._one(name, star, product, exptime)

    def _one(self, name: str, star: int, product: str, exptime: float | None) -> Iterator[tuple]:
        error, fresh = None, False
        for attempt in range(ATTEMPTS):
            try:
                at, old = self._local(name)
                with open(at, newline="") as lines:
                    rows = [(star, product, exptime, float(t), float(x) if x else None, None) for t, x in csv.reader(lines)]
                yield from rows
                return
            except (OSError, EOFError) as e:
                error = f"{type(e).__name__}: {e}"[:300]
                if attempt + 1 < ATTEMPTS:
                    time.sleep(self.pause * 2**attempt)
            except ValueError as e:
                error = f"CorruptFileError: error in reading data product: {e}"[:300]
                if not (old and not fresh):
                    break
                os.remove(at)
                fresh = True
        yield (star, product, exptime, None, None, error)


class LightCurveArchive(DataSource):
    """A folder of ``<star>_<product>.csv`` files, each with lines ``time,flux``."""

    @classmethod
    def name(cls) -> str:
        return "light_curve_archive"

    def schema(self) -> str:
        return "star_id long, product_id string, exptime_s double, t_bkjd double, flux double, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def opened(spark: SparkSession, path: str, **options) -> DataFrame:
    """The archive at ``path`` as a table; ``lease``, ``cache``, ``gap_s``, ``pause_s`` and ``tasks`` are options. Sets the session up for filters in sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LightCurveArchive)
    return spark.read.format(LightCurveArchive.name()).options(path=path, **options).load()


def download(spark: SparkSession, path: str, stars: list[int], exptime_s: float = 1800.0, **options) -> DataFrame:
    """All products of one cadence of the named stars: only their files are asked for."""
    d = opened(spark, path, **options)
    return d.where(F.col("star_id").isin(stars) & (F.col("exptime_s") == exptime_s))
