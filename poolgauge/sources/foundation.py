"""A stored foundation with a manifest: partitions are appended once, verified, and found again after a crash.

Below the root lie the partitions (``deal_id=…/reporting_period=…``) and

* ``_manifest``: JSON lines, a row per partition: where it came from (member,
  CRC-32 and bytes in the archive), its records, and a digest of its rows. The
  digest is a sum of row hashes, so unlike an exclusive-or it counts equal
  rows, and digests of partitions add up to the digest of all of them.
* ``_intents``: what an append is about to take over. It is written after the
  staged rows are verified and before the first rename, and goes when the
  manifest has the partitions.

An append stages rows in a folder of its own, reads them back, and compares
with what :class:`~pyspark.sql.Observation` counted while they were written:
records, the sum of row hashes, and rows that break intake's rules. The source
is scanned once. A crash before the intent leaves a staged folder, which
:meth:`Foundation.recover` removes; a crash after it leaves renames to do, which
it does, whatever part was done. Folders that neither the manifest nor an
intent names are put aside, not read and not deleted.

One writer at a time, as with any folder that has no transactions. The driver
holds the manifest's keys: one per partition folder, as listing them does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from poolgauge import storage
from poolgauge.functions.layout import FIELD_NAMES, LINEAGE
from poolgauge.operators.control import GateError
from poolgauge.sources import archive, intake
from poolgauge.sources.intake import row_hash

KEYS = ("deal_id", "reporting_period")
MANIFEST = "deal_id string, reporting_period string, path string, source_member string, crc32 long, bytes long, source_field_count int, records long, digest_a decimal(38,0), digest_b decimal(38,0), appended string"
#: What tells that a partition is as it was: the digest is of typed or stored rows alike.
FACTS = ("records", "digest_a", "digest_b")


def digest(hashes: list[Column]) -> list[Column]:
    """Sums of two row hashes; wide enough for any number of rows."""
    whole = lambda part: F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)")
    # the halves of a hash are summed as longs
    halves = lambda h: whole(F.shiftright(h, 32)) * F.lit(2**32).cast("decimal(10,0)") + whole(h.bitwiseAND(F.lit(2**32 - 1)))
    return [halves(h).cast("decimal(38,0)").alias(f"digest_{s}") for s, h in zip("ab", hashes)]


def partition_facts(rows: DataFrame) -> DataFrame:
    """deal_id, reporting_period, records, digest_a and digest_b of rows; one aggregation."""
    columns = sorted(c for c in rows.columns if c not in KEYS)
    # hashes are columns of their own first, so that each is computed once
    hashed = rows.select(*KEYS, *[row_hash(columns, s).alias(s) for s in "ab"])
    return hashed.groupBy(*KEYS).agg(F.count("*").alias("records"), *digest([F.col(s) for s in "ab"]))


def text_facts(rows: DataFrame, by: tuple[str, ...], **more: Column) -> DataFrame:
    """Records and digests of rows that tasks made texts of (see :mod:`intake`), and other counts."""
    hashed = rows.select("*", *[intake.text_hash(s).alias(s) for s in "ab"])
    return hashed.groupBy(*by).agg(F.count("*").alias("records"), *digest([F.col(s) for s in "ab"]), *[c.alias(n) for n, c in more.items()])


def repeated_loans(rows: DataFrame) -> int:
    """How many loans of a pool, deal and period have several rows.

    Rows are counted by a hash of a loan's keys, so a number per row is
    shuffled; only rows whose hash is met again are counted by the keys.
    """
    keys = (*KEYS, "reference_pool_number", "loan_identifier")
    keyed = rows.select(*keys, F.xxhash64(*keys).alias("hash"))
    shared = storage.cut(keyed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    if shared.isEmpty():
        return 0
    return keyed.join(shared, "hash", "left_semi").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").count()


class Foundation:
    """Partitions below a root, and their manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, *parts: str) -> str:
        return storage.joined(self.root, *parts)

    def manifest(self) -> DataFrame:
        if not storage.names(self._at("_manifest")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(self._at("_manifest"))

    def facts(self) -> DataFrame:
        """What an append-only check compares of each partition; no partition is read."""
        return self.manifest().select(*KEYS, *FACTS)

    def known(self) -> set[tuple[str, str]]:
        return {tuple(r) for r in self.manifest().select(*KEYS).collect()}

    def read(self, keys: list[tuple[str, str]] | None = None) -> DataFrame:
        """Rows of all partitions, or of some: filters on both keys prune folders before anything is read."""
        rows = archive.read(self.spark, self.root)
        if keys is None:
            return rows
        deals, periods = sorted({d for d, _ in keys}), sorted({p for _, p in keys})
        rows = rows.where(F.col("deal_id").isin(deals) & F.col("reporting_period").isin(periods))
        if len(keys) == len(deals) * len(periods):
            return rows
        named = self.spark.createDataFrame(sorted(keys), "deal_id string, reporting_period string")
        return rows.join(F.broadcast(named), list(KEYS), "left_semi")  # a row per partition folder

    def append(self, rows: DataFrame, members: DataFrame | None = None) -> dict:
        """Stage, verify, note the intent, take over, note in the manifest. Returns partitions, records and their paths.

        ``members`` (member, crc32, bytes: an archive's inventory) fills in
        where partitions came from. Rows of :func:`archive.foundation` are held
        to intake's rules as well; others have no member to be held to. For
        whole archives :meth:`append_archive` does the same at a fraction of
        the cost.
        """
        self.recover()
        number = uuid.uuid4().hex
        staged, seen = self._at(f"_staged-{number}"), Observation()
        stored = sorted([c for c in (*LINEAGE, *FIELD_NAMES) if c not in KEYS])
        rules = {n: F.count_if(F.coalesce(c, F.lit(False))) for n, c in archive.row_rules(rows).items()}
        wanted = [F.count("*").alias("records"), *digest([row_hash(stored, s) for s in "ab"]), *[c.alias(n) for n, c in rules.items()]]
        with archive.compiled(self.spark):
            archive.write(rows.observe(seen, *wanted), staged, whole_members=bool(rules))
        offered = seen.get
        with self._staging(staged):
            if any(offered[n] for n in rules):
                raise GateError(f"members: { {n: offered[n] for n in rules} }")
            parts = self._described(staged, members)
            total = {c: sum(p[c] for p in parts) for c in (*FACTS, "mixed")}
            if parts and any(total[c] != offered[c] for c in FACTS):  # tasks that ran again after a lost executor are observed again: count the source itself
                offered = rows.agg(*wanted).first().asDict()
                if any(total[c] != offered[c] for c in FACTS):
                    raise GateError(f"staged rows: {total}")
            repeated = repeated_loans(archive.read(self.spark, staged)) if rules else 0
            if total["mixed"] or repeated:
                raise GateError(f"members: {total | {'duplicate_loans': repeated}}")
            return self._committed(number, staged, parts)

    def append_archive(self, path: str) -> dict:
        """:meth:`append` of all accepted members of a delivery, which tasks store as they read them.

        What is compared is what the archives' lines gave and what is read back
        of the staged files, by partition. Members whose loans are not in order
        are left to Spark's writer, which sorts them.
        """
        self.recover()
        number = uuid.uuid4().hex
        staged = self._at(f"_staged-{number}")
        inventory = archive.classified(archive.inventory(self.spark, path))
        place = {m: uri for uri, m, _, _ in archive.directory(path)}
        members = [(place[m], m, d, p) for m, d, p in archive.accepted(inventory)]
        if not members:
            return {"partitions": 0, "records": 0, "paths": []}
        rows = intake.store(self.spark, members, staged)
        suspect = F.col("member_period").isNotNull()
        rules = {n: F.count_if(suspect & F.coalesce(c, F.lit(False))) for n, c in archive.row_rules(rows).items()}
        with self._staging(staged):
            offered = {members[r["part"]][1:]: r for r in text_facts(rows, ("part",), ordered=F.bool_and("ordered"), **rules).collect()}  # a row per member
            if broken := {n: k for n in rules if (k := sum(r[n] for r in offered.values()))}:
                raise GateError(f"members: {broken}")
            if loose := [m for m, r in offered.items() if not r["ordered"]]:
                with archive.compiled(self.spark):
                    archive.write(archive.lines(self.spark, path, loose, archive.INTAKE_SCHEMA), staged, mode="append", whole_members=True)
                again = archive.read(self.spark, staged).where(F.concat_ws("/", *KEYS).isin([f"{d}/{p}" for _, d, p in loose]))
                if repeated := repeated_loans(again):
                    raise GateError(f"members: { {'duplicate_loans': repeated} }")
            parts = self._described(staged, inventory)
            if mixed := sum(p["mixed"] for p in parts):
                raise GateError(f"members: { {'mixed_widths': mixed} }")
            got = {(p["source_member"], p["deal_id"], p["reporting_period"]): [p[c] for c in FACTS] for p in parts}
            if got != {m: [r[c] for c in FACTS] for m, r in offered.items()}:
                raise GateError("staged rows are not what the members gave")
            return self._committed(number, staged, parts)

    @contextmanager
    def _staging(self, staged: str) -> Iterator[None]:
        """What fails its gate is not left staged."""
        try:
            yield
        except GateError:
            storage.remove(staged)
            raise

    def _committed(self, number: str, staged: str, parts: list[dict]) -> dict:
        """Note the intent of verified rows and take them over."""
        if again := sorted(self.known() & {(p["deal_id"], p["reporting_period"]) for p in parts}):
            raise GateError(f"stored partitions are not written again: {again[:3]}")
        paths = [path for _, _, path in self._folders(staged)]
        manifest = [{k: int(v) if isinstance(v, Decimal) else v for k, v in p.items() if k != "mixed"} for p in parts]
        self._note("_intents", number, [json.dumps({"staged": f"_staged-{number}", "paths": paths, "manifest": manifest})])
        self._take_over(number)
        return {"partitions": len(parts), "records": sum(p["records"] for p in parts), "paths": paths}

    @staticmethod
    def _folders(root: str) -> list[tuple[str | None, str | None, str]]:
        """Deal, period and path of the partition folders below a root."""
        found = [storage.joined(d, p) for d in storage.names(root) if d.startswith("deal_id=") for p in storage.names(storage.joined(root, d)) if p.startswith("reporting_period=")]
        value = lambda name: None if (v := unquote(name.split("=", 1)[1])) == "__HIVE_DEFAULT_PARTITION__" else v
        return [(*map(value, path.split("/")), path) for path in found]

    def folders(self) -> list[tuple[str | None, str | None, str]]:
        """Deal, period and path of all stored partitions."""
        return self._folders(self.root)

    def _described(self, root: str, members: DataFrame | None, keys: set | None = None) -> list[dict]:
        """A row per partition folder: what the manifest notes of it, and whether its rows differ in width, which intake forbids."""
        folders = [f for f in self._folders(root) if keys is None or f[:2] in keys]
        if not folders:
            return []
        rows = intake.back(self.spark, [storage.joined(root, path) for _, _, path in folders])
        # texts are grouping keys first: Spark would sort all rows for the greatest text of a group
        parts = text_facts(rows, ("part", "source_member", "source_field_count"))
        widths = (F.min("source_field_count"), F.max("source_field_count"))
        own = parts.groupBy("part").agg(*[F.sum(c).alias(c) for c in FACTS], F.max("source_member").alias("source_member"), widths[1].alias("source_field_count"), F.coalesce((widths[0] != widths[1]).cast("int"), F.lit(0)).alias("mixed"))
        come = {} if members is None else {r["member"]: r for r in members.select("member", "crc32", "bytes").collect()}  # the archive's directory
        found = []
        for r in own.collect():
            deal, period, _ = folders[r["part"]]
            known = come.get(r["source_member"])
            found.append({"deal_id": deal, "reporting_period": period, **{k: v for k, v in r.asDict().items() if k != "part"}, "crc32": known and known["crc32"], "bytes": known and known["bytes"]})
        return found

    def _note(self, folder: str, number: str, lines: list[str]) -> None:
        storage.write_text(self._at(folder, f"{number}.json"), "\n".join(lines) + "\n")

    def _take_over(self, number: str) -> None:
        """Do what an intent says, as far as it is not done."""
        intent = json.loads(storage.read_text(self._at("_intents", f"{number}.json")))
        for path in intent["paths"]:
            staged = self._at(intent["staged"], path)
            if storage.exists(staged):
                storage.move(staged, self._at(path))
            elif not storage.exists(self._at(path)):
                raise GateError(f"an append that broke off has lost {path}")
        self._note("_manifest", number, [json.dumps({**p, "appended": number, "path": f"deal_id={p['deal_id']}/reporting_period={p['reporting_period']}"}) for p in intent["manifest"]])
        storage.remove(self._at(intent["staged"]))
        storage.remove(self._at("_intents", f"{number}.json"))

    def recover(self) -> dict:
        """Finish appends that broke off after their intent, remove what others staged, and put folders aside that nothing names."""
        done = [n.removesuffix(".json") for n in storage.names(self._at("_intents")) if n.endswith(".json") and not n.startswith(".")]
        for number in done:
            self._take_over(number)
        left = [n for n in storage.names(self.root) if n.startswith("_staged-")]
        for n in left:
            storage.remove(self._at(n))
        known = {tuple(r) for r in self.manifest().select("path").collect()}
        found = {(storage.joined(d, p),) for d in storage.names(self.root) if d.startswith("deal_id=") for p in storage.names(self._at(d))}
        if lost := sorted(known - found):
            raise GateError(f"partitions of the manifest are gone: {lost[:3]}")
        for (path,) in orphans if (orphans := sorted(found - known)) else []:
            storage.move(self._at(path), self._at(f"_orphans-{uuid.uuid4().hex[:8]}", path))
        return {"finished": done, "staged": left, "orphans": [p for (p,) in orphans]}

    def verify(self, keys: list[tuple[str, str]] | None = None) -> None:
        """Read partitions again and compare with the manifest, or GateError. Reads what it verifies."""
        own = lambda rows: sorted((tuple(r[c] for c in (*KEYS, *FACTS)) for r in rows), key=str)
        now, noted = own(self._described(self.root, None, None if keys is None else set(keys))), own(self.facts().collect())
        if keys is not None:
            there = {r[:2] for r in now}
            noted = [r for r in noted if r[:2] in there]
        if now != noted:
            raise GateError("stored partitions are not what the manifest says")

    @classmethod
    def adopt(cls, spark: SparkSession, root: str) -> Foundation:
        """A manifest for partitions that were written without one; reads them once."""
        made = cls(spark, root)
        if not storage.names(made._at("_manifest")):
            number = uuid.uuid4().hex
            lines = [{k: int(v) if isinstance(v, Decimal) else v for k, v in p.items() if k != "mixed"} for p in made._described(made.root, None)]
            made._note("_manifest", number, [json.dumps({**p, "path": f"deal_id={p['deal_id']}/reporting_period={p['reporting_period']}", "appended": number}) for p in lines])
        return made
