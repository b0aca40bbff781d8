"""A registry of promoted models: numbered versions, each published by one atomic step.

Layout below the registry's folder: `models/<id>/` holds a whole model (its fitted
boosters and a small description), `versions/<number>.json` names the model of a
version with its features, inputs and error. A model is written first, whole and
under a new name; then its version file, written elsewhere, is moved to the next
number, which fails if that number is taken. So readers see a version with all
of its model or not at all, a crash before the move leaves the old champion, and
of two writers one wins while the other decides anew against the new champion.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from zonecast.operators.ensemble import Blending, Linear, Stacking, Voting
from zonecast.operators.modeling import Booster

Model = Booster | Stacking | Blending | Voting


class VersionTaken(Exception):
    """Another writer has published the version first."""


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, target = _path(spark, path)
    out = system.create(target, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    system, source = _path(spark, path)
    stream = system.open(source)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def move_new(spark: SparkSession, source: str, target: str) -> None:
    """Move a file to a name that nothing has yet; `VersionTaken` if something has it.

    Stores rename without overwriting in one step. A local file system does not,
    so there the file gets its second name by a hard link, which does.
    """
    system, old = _path(spark, source)
    _, new = _path(spark, target)
    jvm = spark._jvm
    system.mkdirs(new.getParent())
    try:
        if new.toUri().getScheme() == "file":
            nio = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(nio.get(new.toUri()), nio.get(old.toUri()))
            system.delete(old, False)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(old, new, options)
    except Exception as error:
        if "AlreadyExists" in str(error):
            raise VersionTaken(target) from error
        raise


# Models as folders --------------------------------------------------------------


def bases_of(model: Model) -> list[Booster]:
    return [model] if isinstance(model, Booster) else model.fitted


def save_model(spark: SparkSession, model: Model, path: str) -> dict:
    """Write a fitted model below `path`; returns its description, which is written last."""
    bases = bases_of(model)
    about: dict = {"class": type(model).__name__, "bases": [{"kind": b.kind, "params": b.params, "features": b.features} for b in bases]}
    if isinstance(model, Stacking):
        about |= {"intercept": float(model.meta.intercept), "coefficients": [float(c) for c in model.meta.coefficients],
                  "alpha": model.alpha, "n_folds": model.n_folds, "mode": model.mode, "fold_options": model.fold_options}
    elif isinstance(model, Blending):
        about["weights"] = [float(w) for w in model.weights_]
    for i, base in enumerate(bases):
        base.save(f"{path}/base-{i}")
    write_text(spark, f"{path}/model.json", json.dumps(about))
    return about


def load_model(spark: SparkSession, path: str) -> Model:
    about = json.loads(read_text(spark, f"{path}/model.json"))
    bases = []
    for i, b in enumerate(about["bases"]):
        base = Booster.load(f"{path}/base-{i}", b["kind"], b["features"])
        base.params = b["params"]
        bases.append(base)
    if about["class"] == "Booster":
        return bases[0]
    if about["class"] == "Stacking":
        model: Model = Stacking(bases, about["alpha"], about["n_folds"], about["mode"], **about["fold_options"])
        model.meta = Linear(about["intercept"], about["coefficients"])
    elif about["class"] == "Blending":
        model = Blending(bases)
        model.weights_ = about["weights"]
    else:
        model = Voting(bases)
    model.fitted = bases
    return model


# Versions -----------------------------------------------------------------------


@dataclass
class Version:
    number: int
    name: str
    mape: float
    model: str
    kind: str
    features: list[str]
    inputs: list[str]
    promoted_at: str

    @property
    def label(self) -> str:
        return f"{self.name}-v{self.number}"


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        system, folder = _path(self.spark, f"{self.root}/versions")
        if not system.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in system.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def version(self, number: int) -> Version:
        return Version(number, **json.loads(read_text(self.spark, self._file(number))))

    def champion(self) -> Version | None:
        """The newest published version."""
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else None

    def load(self, number: int | None = None) -> tuple[Version, Model]:
        """A version, by default the champion, with its model."""
        found = self.champion() if number is None else self.version(number)
        if found is None:
            raise LookupError(f"no version in {self.root}")
        return found, load_model(self.spark, f"{self.root}/models/{found.model}")

    def stage(self, model: Model) -> str:
        """Write a model that no version names yet; returns its id."""
        name = uuid.uuid4().hex
        save_model(self.spark, model, f"{self.root}/models/{name}")
        return name

    def publish(self, staged: str, model: Model, name: str, mape: float, after: int) -> Version:
        """Make a staged model the version that follows number `after`; `VersionTaken` if there is one by now."""
        bases = bases_of(model)
        now = self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")").first()[0]
        version = Version(after + 1, name, mape, staged, type(model).__name__, list(bases[0].features), list(bases[0].inputs), now)
        fields = {k: v for k, v in vars(version).items() if k != "number"}
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}.json"
        write_text(self.spark, draft, json.dumps(fields))
        move_new(self.spark, draft, self._file(version.number))
        return version

    def promote(self, model: Model, name: str, mape: float, better: Callable[[Version | None], bool], attempts: int = 10) -> Version | None:
        """Publish the model if it is `better` than the champion at that moment; null if it is not.

        The model is written once. If another writer publishes first, the decision
        is made again against that version.
        """
        staged = None
        for _ in range(attempts):
            champion = self.champion()
            if not better(champion):
                return None
            staged = staged or self.stage(model)
            try:
                return self.publish(staged, model, name, mape, champion.number if champion else 0)
            except VersionTaken:
                continue
        raise VersionTaken(f"{attempts} writers were faster in {self.root}")

    def history(self) -> DataFrame:
        """One row per version."""
        rows = [(v.number, v.name, v.mape, v.kind, len(v.features), v.promoted_at) for v in map(self.version, self.numbers())]
        return self.spark.createDataFrame(rows, "version bigint, model string, mape double, kind string, n_features bigint, promoted_at string")

    def unpublished(self) -> list[str]:
        """Models that no version names: left by losing writers or crashes, or about to be published."""
        system, folder = _path(self.spark, f"{self.root}/models")
        named = {self.version(n).model for n in self.numbers()}
        return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName() not in named) if system.exists(folder) else []

    def profile_path(self, version: Version) -> str:
        """Where what the drift checks know of the version's training rows is kept."""
        return f"{self.root}/models/{version.model}/profile"

    def _file(self, number: int) -> str:
        return f"{self.root}/versions/{number:09d}.json"
