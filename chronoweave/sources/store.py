"""Tables on disk: readers, a store of named tables with read-through, releases and databases, configuration trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """parquet, orc, csv, json or jdbc; the columns are pruned in the scan."""
    r = spark.read.format(fmt).options(**options)
    df = (r.schema(schema) if schema else r).load(path) if fmt != "jdbc" else r.load()
    return df.select(*columns) if columns else df


def text_columns(df: DataFrame) -> DataFrame:
    """Binary columns as UTF-8 text."""
    return df.withColumns({c: F.decode(c, "UTF-8") for c, t in df.dtypes if t == "binary"})


class Store:
    """A folder of parquet tables, named and optionally partitioned, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keys(self) -> list[str]:
        p, fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def __contains__(self, key: str) -> bool:
        return key in self.keys()

    def write(self, key: str, df: DataFrame, partition_by: list[str] | None = None, overwrite: bool = False) -> None:
        w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{key}")

    def read(self, key: str, columns: list[str] | None = None) -> DataFrame:
        return read(self.spark, f"{self.path}/{key}", columns=columns)

    def remove(self, key: str) -> None:
        p, fs = self._fs()
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, key), True)

    def get(self, key: str, build: Callable[[], DataFrame], create: bool = False, save: bool = True, overwrite: bool = False, columns: list[str] | None = None) -> DataFrame:
        """The stored table, or what build() gives, saved; create builds even where one is stored. Columns are part of
        what is stored: another choice of them is another table."""
        if columns:
            key = f"{key}__{'_'.join(sorted(columns))}"
        if key in self and not create:
            return self.read(key)
        df = build()
        df = df.select(*columns) if columns else df
        if save:
            self.write(key, df, overwrite=overwrite or create)
            return self.read(key)
        return df

    def latest(self, prefix: str, release: int) -> str | None:
        """The stored key `prefix<release>` of the greatest release that is not before the given one."""
        found = [(int(k[len(prefix) :]), k) for k in self.keys() if k.startswith(prefix) and k[len(prefix) :].isdigit()]
        return max((x for x in found if x[0] >= release), default=(0, None))[1]

    def reuse(self, prefix: str, release: int, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that later releases hold as well: the latest stored one serves, and older ones go."""
        key = self.latest(prefix, release)
        if key is None:
            key = f"{prefix}{release}"
            self.write(key, build())
        for k in self.keys():
            if k.startswith(prefix) and k[len(prefix) :].isdigit() and k != key:
                self.remove(k)
        return self.read(key)

    def compact(self, key: str, files: int = 1) -> None:
        """Rewrites a table into so many files. The old one is moved aside before the new one takes its place, and
        removed last; recover() puts right what an interruption leaves."""
        self.write(f"{key}__new", self.read(key).repartition(files), overwrite=True)
        self._move(key, f"{key}__old")
        self._move(f"{key}__new", key)
        self.remove(f"{key}__old")

    def _move(self, a: str, b: str) -> None:
        path, (p, fs) = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path, self._fs()
        if not fs.rename(path(p, a), path(p, b)):
            raise OSError(f"can't move {a} to {b}")

    def recover(self) -> None:
        for k in self.keys():
            if k.endswith("__old"):
                if k[:-5] in self:
                    self.remove(k)
                else:
                    self._move(k, k[:-5])
        for k in self.keys():
            if k.endswith("__new"):
                self.remove(k)


class Matches:
    """Stored results of conversions by dataset, which hold as long as the dataset's names are the same."""

    def __init__(self, store: Store):
        self.store = store

    def get(self, dataset: str, names: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
        asked = names.toDF("query_id").distinct()
        key, old = f"match_{dataset}", f"match_{dataset}_names"
        if key in self.store and old in self.store:
            was = self.store.read(old)
            if asked.exceptAll(was).isEmpty() and was.exceptAll(asked).isEmpty():
                return self.store.read(key)
        self.store.write(key, convert(asked), overwrite=True)
        self.store.write(old, asked, overwrite=True)
        return self.store.read(key)


def table_name(kind: str, release: int, *parts: str, form: str | None = None) -> str:
    """The name under which a table of a release is stored."""
    return "_".join([f"ens{release}", kind, *parts, *([form] if form else [])])


def releases_of(names: DataFrame, organism: str, column: str = "name", first: int | None = None, last: int | None = None) -> DataFrame:
    """(database, release) of schema names `<organism>_core_<release>_<build>`, first to last; other names do not count,
    and neither do releases that are no whole number above 0."""
    rx = rf"^{organism}_core_([0-9]+)_.+$"
    d = names.filter(F.col(column).rlike(rx))
    d = d.select(F.col(column).alias("database"), F.regexp_extract(column, rx, 1).try_cast("int").alias("release")).filter("release > 0")
    if first is not None:
        d = d.filter(F.col("release") >= first)
    if last is not None:
        d = d.filter(F.col("release") <= last)
    return d.orderBy("release", "database")


def database_of(names: DataFrame, organism: str, release: int, column: str = "name") -> str:
    """The one schema of a release."""
    found = [r.database for r in releases_of(names, organism, column, release, release).take(2)]
    if len(found) != 1:
        raise LookupError(f"{len(found) or 'no'} schemas of {organism} {release}: {found}")
    return found[0]


class Indicators:
    """Builders of tables by name, `base` or `base_parameter`, with a store in front of them."""

    def __init__(self, store: Store | None = None):
        self.builders: dict[str, Callable[..., DataFrame]] = {}
        self.store = store

    def add(self, name: str, build: Callable[..., DataFrame]) -> Indicators:
        self.builders[name] = build
        return self

    def get(self, indicator: str, create: bool = False, save: bool = True, overwrite: bool = False) -> DataFrame:
        base = max((n for n in self.builders if indicator == n or indicator.startswith(f"{n}_")), key=len, default=None)
        if base is None:
            raise KeyError(f"{indicator}: not one of {sorted(self.builders)}")
        more = [indicator[len(base) + 1 :]] if indicator != base else []
        build = lambda: self.builders[base](*more)
        return self.store.get(indicator, build, create, save, overwrite) if self.store else build()


def payload(spark: SparkSession, source: str, timeout: float = 10.0) -> DataFrame:
    """(json) of a file that Spark reads, or of an http(s) address."""
    if source.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(source, timeout=timeout) as got:  # noqa: S310
            return spark.createDataFrame([(got.read().decode(),)], "json string")
    return spark.read.text(source, wholetext=True).toDF("json")


def read_config(spark: SparkSession, path: str, default: str | None = None) -> DataFrame:
    """A configuration tree from a YAML (or JSON) file, the default one where there is none at path."""
    import json
    import os

    use = path if os.path.exists(path) else default
    if use is None:
        raise FileNotFoundError(path)
    with open(use) as f:
        text = f.read()
    try:
        tree = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ImportError(f"{use} is no JSON, and there is no yaml package to read it with") from e
        tree = yaml.safe_load(text)
    return flatten_config(spark, tree)


def config_paths(folder: str, organism: str) -> dict[str, str]:
    """Where the template of an organism's configuration and its edited form lie."""
    return {"template": f"{folder.rstrip('/')}/{organism}_externals_template.yml", "modified": f"{folder.rstrip('/')}/{organism}_externals_modified.yml"}


def write_template(config: DataFrame, organism: str, form: str, path: str) -> None:
    """config_template() as a tree, in JSON, which YAML readers take: a row for each database and assembly."""
    import json

    tree: dict = {organism: {form: {}}}
    for r in config.orderBy("db", "assembly").collect():
        spec = tree[organism][form].setdefault(r["db"], {"assembly": {}, "db_index": r["db_index"]})
        spec["assembly"][str(r["assembly"])] = {"release": r["releases"], "include": bool(r["include"])}
    with open(path, "w") as f:
        json.dump(tree, f, indent=1, sort_keys=True)


def matrix(spark: SparkSession, path: str, dataset: str, fmt: str = "parquet", obs: str = "obs", feature: str = "feature", value: str = "value", wide: bool = False, **options) -> DataFrame:
    """(dataset, obs, feature, value) of a table with a row a cell, or with `wide` a column a feature; cells that are
    zero or null are left out."""
    df = read(spark, path, fmt, **options)
    if wide:
        df = df.unpivot(obs, [c for c in df.columns if c != obs], feature, value)
    out = df.select(F.lit(dataset).alias("dataset"), F.col(obs).cast("string").alias("obs"), F.col(feature).alias("feature"), F.col(value).cast("double").alias("value"))
    return out.filter("value is not null and value <> 0")


def features(spark: SparkSession, path: str, fmt: str = "parquet", column: str = "feature", **options) -> DataFrame:
    """(feature, place): a matrix's names in the order of their first appearance; only their column is read."""
    d = read(spark, path, fmt, columns=[column], **options).select(F.col(column).alias("feature"), F.monotonically_increasing_id().alias("place"))
    return d.groupBy("feature").agg(F.min("place").alias("place"))


def species(payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a JSON payload (json): synonyms (synonym, name, ambiguous) and releases (name, release)."""
    schema = "species array<struct<name: string, common_name: string, display_name: string, aliases: array<string>, release: int>>"
    s = payload.select(F.explode(F.from_json("json", schema)["species"]).alias("s")).select("s.*")
    every = F.array_distinct(F.array_compact(F.concat(F.array("name", "common_name", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    syn = s.select("name", F.explode(every).alias("synonym")).distinct()
    n = syn.groupBy("synonym").agg(F.count("*").alias("n"))
    return syn.join(n, "synonym").select("synonym", "name", (F.col("n") > 1).alias("ambiguous")), s.select("name", "release").distinct()


def formal_name(synonyms: DataFrame, name: str) -> str:
    found = synonyms.filter(F.lower("synonym") == name.lower()).select("name").distinct().take(2)
    if not found:
        raise KeyError(name)
    if len(found) > 1:
        raise ValueError(f"{name} is ambiguous")
    return found[0][0]


def config_template(x: DataFrame) -> DataFrame:
    """(db, assembly, releases, include, db_index) from (db, assembly, release): releases as sorted text."""
    from pyspark.sql import Window as W

    g = x.select("db", "assembly", "release").distinct().groupBy("db", "assembly")
    g = g.agg(F.array_join(F.transform(F.array_sort(F.collect_set("release")), lambda r: r.cast("string")), ",").alias("releases"))
    return g.select("db", "assembly", "releases", F.lit(False).alias("include"), (F.dense_rank().over(W.orderBy("db")) - 1).cast("int").alias("db_index"))


def flatten_config(spark: SparkSession, tree: dict) -> DataFrame:
    """(organism, form, db, assembly, releases, include) of a nested configuration, as a YAML file gives it."""
    rows = [(o, f, db, int(a), str(v["release"]), bool(v["include"])) for o, forms in tree.items() for f, dbs in forms.items() for db, spec in dbs.items() for a, v in spec["assembly"].items()]
    return spark.createDataFrame(rows, "organism string, form string, db string, assembly int, releases string, include boolean")


def allowed(config: DataFrame, release: int, what: str = "db") -> DataFrame:
    """Databases (or assemblies) that the configuration includes at a release."""
    d = config.filter("include").withColumn("r", F.explode(F.split("releases", ",")))
    return d.filter(F.trim("r").cast("int") == release).select(what).distinct()


def up_to_date(config: DataFrame, release: int) -> bool:
    return not config.filter(F.array_contains(F.split("releases", ","), str(release))).isEmpty()
