"""Build manifests, held against the files that they name and the flags that their profile asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FILE = "struct<path:string,sha256:string>"
MANIFEST = f"""case string, build string, profile string, target string, build_id string, edition string, crate_name string, schema_version int,
 source struct<kind:string,path:string,sha256:string>, artifacts struct<non_stripped:{_FILE},stripped:struct<path:string,sha256:string,stripped_from_sha256:string>>,
 compiler struct<flags:array<string>>, strip struct<flags:array<string>>,
 cargo struct<package:string,binary:string,root_namespace:string,candidate_namespaces:array<string>,profile_config:string,environment:struct<RUSTC:string,RUSTFLAGS:string>,manifest:{_FILE},lockfile:{_FILE}>"""

# Fixed values of builds: versions, target, edition, flags.
VERSIONS = (2, 3)
TARGET, EDITION = "x86_64-unknown-linux-gnu", "2024"
STRIP = ("--strip-all",)
COMMON = ("-C", "opt-level=3", "-C", "debuginfo=0", "-C", "debug-assertions=off", "-C", "overflow-checks=off")
PROFILES = {"plain": ("-C", "codegen-units=16", "-C", "lto=false", "-C", "panic=unwind"), "min": ("-C", "codegen-units=1", "-C", "lto=true", "-C", "panic=abort")}
BUILDS = {"O3S": (), "O3KS": ("--cfg", "keep")}


def flags(profile: str, build: str) -> list[str]:
    return [*COMMON, *PROFILES[profile], *BUILDS[build.upper()]]


def profile_config(profile: str) -> str:
    """The package manager's overlay that equals the profile's flags."""
    units, lto, panic = (flag.partition("=")[2] for flag in PROFILES[profile][1::2])
    values = {"opt-level": "3", "debug": "0", "debug-assertions": "false", "overflow-checks": "false", "codegen-units": units, "lto": lto, "panic": f'"{panic}"', "incremental": "false", "strip": '"none"'}
    return "[profile.release]\n" + "".join(f"{k} = {v}\n" for k, v in values.items())


def manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per manifest, with ``graph_id`` case.build.profile."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(paths).withColumn("graph_id", F.concat_ws(".", "case", "build", "profile"))


def named_files(rows: DataFrame) -> DataFrame:
    """(graph_id, what, path, sha256) of the files and folders that manifests name."""
    package = F.col("kind") == "subject"
    kind = F.coalesce("source.kind", F.when(F.col("schema_version") == 2, "case"))
    entry = lambda what, field: F.struct(F.lit(what).alias("what"), F.col(f"{field}.path").alias("path"), F.col(f"{field}.sha256").alias("sha256"))
    parts = F.array(entry("source", "source"), entry("binary", "artifacts.non_stripped"), entry("stripped binary", "artifacts.stripped"))
    cargo = F.when(package, F.array(entry("package manifest", "cargo.manifest"), entry("lock file", "cargo.lockfile"))).otherwise(F.array().cast("array<struct<what:string,path:string,sha256:string>>"))
    return rows.withColumn("kind", kind).select("graph_id", F.explode(F.concat(parts, cargo)).alias("f")).select("graph_id", "f.*")


def violations_manifest(rows: DataFrame, files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(graph_id, rule, key). files: (path, sha256), digests computed now; for a package's source folder ``sinks.inputs_digest``.

    expected: (graph_id) of the builds that must have a manifest.
    """
    named = named_files(rows).join(files.select("path", F.col("sha256").alias("now")).distinct(), "path", "left")
    cases = [F.when((F.col("profile") == p) & (F.col("build") == b), F.array(*map(F.lit, flags(p, b)))) for p in PROFILES for b in BUILDS]
    overlays = [F.when(F.col("profile") == p, F.lit(profile_config(p))) for p in PROFILES]
    kind = F.coalesce("source.kind", F.when(F.col("schema_version") == 2, "case"))
    package = kind == "subject"
    digest = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    tests: dict[str, Column] = {
        "unsupported version": F.col("schema_version").isin(*VERSIONS), "target": F.col("target") == TARGET, "build id is blank": F.col("build_id") != "", "source kind": kind.isin("case", "subject"),
        "edition": package | (F.col("edition") == EDITION), "crate name": F.col("crate_name") == F.when(package, F.col("cargo.binary")).otherwise(F.col("case")),
        "root namespace": ~package | ((F.col("cargo.root_namespace") == F.col("cargo.binary")) & F.array_contains("cargo.candidate_namespaces", F.col("cargo.root_namespace")) & (F.col("cargo.package") != "")),
        "package flags": ~package | (F.col("cargo.environment.RUSTFLAGS") == F.when(F.col("build") == "O3KS", " ".join(BUILDS["O3KS"])).otherwise("")), "package profile": ~package | (F.col("cargo.profile_config") == F.coalesce(*overlays)),
        "compiler flags": F.col("compiler.flags") == F.coalesce(*cases), "strip flags": F.col("strip.flags") == F.array(*map(F.lit, STRIP)),
        "stripped from another binary": F.col("artifacts.stripped.stripped_from_sha256") == F.col("artifacts.non_stripped.sha256"),
    }
    fault = lambda df, rule, key: df.select("graph_id", F.lit(rule).alias("rule") if isinstance(rule, str) else rule.alias("rule"), key.alias("key"))
    none = F.lit(None).cast("string")
    found = [fault(rows.where(~F.coalesce(test, F.lit(False))), rule, none) for rule, test in tests.items()]
    found.append(fault(named.where(~F.coalesce(digest("sha256"), F.lit(False))), F.concat("what", F.lit(" has no digest")), F.col("path")))
    found.append(fault(named.where("now is null"), F.concat("what", F.lit(" is missing")), F.col("path")))
    found.append(fault(named.where("now <> sha256"), F.concat("what", F.lit(" differs")), F.col("path")))
    if expected is not None:
        found.append(fault(expected.join(rows, "graph_id", "left_anti"), "no manifest", none))
    return reduce(DataFrame.unionByName, found)


def verified(rows: DataFrame, files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Identity, namespaces, paths and provenance of manifests; refused where anything differs."""
    from weftgraph.operators.checks import assert_valid

    assert_valid(violations_manifest(rows, files, expected))
    package = F.col("source.kind") == "subject"
    build = F.struct("build_id", F.col("source.sha256").alias("source_sha256"), F.col("artifacts.non_stripped.sha256").alias("non_stripped_sha256"), F.col("artifacts.stripped.sha256").alias("stripped_sha256"))
    return rows.select(
        "graph_id", "build_id", "profile", F.col("source.path").alias("source"), F.coalesce("source.kind", F.lit("case")).alias("source_kind"),
        F.when(package, F.col("cargo.candidate_namespaces")).otherwise(F.array("case")).alias("namespaces"), F.when(package, F.col("cargo.root_namespace")).otherwise(F.col("case")).alias("root_namespace"),
        F.col("artifacts.non_stripped.path").alias("binary"), F.col("artifacts.stripped.path").alias("stripped"), build.alias("provenance"),
    )
