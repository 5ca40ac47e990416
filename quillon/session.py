"""Engine environment: session start, provider options, ordered teardown."""

from __future__ import annotations

import logging
import tempfile
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOG = logging.getLogger("quillon")


def start(app: str = "quillon", master: str | None = None, options: Mapping[str, str] | None = None, executor_env: Mapping[str, str] | None = None) -> SparkSession:
    """Get or create the session. Executor variables are set before the runtime starts.

    Checkpoints go when nothing refers to them any more, unless the options say otherwise.
    A runtime that is already up cannot take executor variables any more, so asking for some is an error.
    """
    if executor_env and SparkSession.getActiveSession() is not None:
        raise RuntimeError("executor variables have to be set before the engine starts")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (executor_env or {}).items():
        builder = builder.config(f"spark.executorEnv.{k}", v)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"} | dict(options or {})
    spark = builder.config(map=conf).getOrCreate()
    LOG.info("engine %s, options %s", spark.version, conf)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local master may go without: it gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set; the driver and executors need a shared folder")
    return tempfile.mkdtemp(prefix="quillon-")


class Registry:
    """Functions registered by name for one session; only what was registered is removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def register(self, name: str, fn, return_type=None) -> None:
        self.spark.udf.register(name, fn, return_type)
        self.names.append(name)

    def define(self, name: str, parameters: str, returns: str, body: str) -> None:
        """A function whose body is an SQL expression; the optimizer puts it in place of the call."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({parameters}) RETURNS {returns} RETURN {body}")
        self.names.append(name)

    def unregister(self) -> list[str]:
        done = []
        while self.names:
            name = self.names.pop()
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")
            done.append(name)
        return done


def teardown(*steps: tuple[str, Callable[[], object]]) -> list[tuple[str, str]]:
    """Run every step in the given order. One that fails is logged and does not stop the next."""
    failed = []
    for name, step in steps:
        try:
            step()
        except Exception as e:
            LOG.exception("teardown step %s", name)
            failed.append((name, f"{type(e).__name__}: {e}"))
    return failed


def when_set(flag: object, action: Callable[[], object]) -> object:
    """The action's result if the flag holds, else None; the action is not touched then."""
    return action() if flag else None


def call(target: object | None, method: str, *args) -> object:
    """target.method(*args), or None if there is no target."""
    return None if target is None else getattr(target, method)(*args)


@contextmanager
def released(resource, method: str = "close") -> Iterator:
    """The resource, let go by its own method however the block ends; None is passed through."""
    try:
        yield resource
    finally:
        call(resource, method)


@contextmanager
def engine(stop: bool = True, **start_options) -> Iterator[tuple[SparkSession, Registry]]:
    """A session with a registry; on the way out caches go, then functions, then the session, each on its own."""
    spark = start(**start_options)
    registry = Registry(spark)
    try:
        yield spark, registry
    finally:
        teardown(
            ("cache", spark.catalog.clearCache),
            ("functions", lambda: when_set(registry.names, registry.unregister)),
            ("session", lambda: when_set(stop, spark.stop)),
        )
