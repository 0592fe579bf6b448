"""A session: text in, lazy DataFrames and outcomes out, over registered frames and managed tables."""

from __future__ import annotations

import contextlib
import copy
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.errors import CardinalityError, CatalogError, CompileError, ConstraintError, TransactionError
from trimodel.functions import compiler
from trimodel.functions.builtins import BUILTINS
from trimodel.functions.udf import Registered
from trimodel.functions.values import Value, common, literal
from trimodel.lang import tree as t
from trimodel.lang.parser import parse
from trimodel.operators import mutate
from trimodel.operators.shape import row_key, with_id
from trimodel.plans.builder import Relation
from trimodel.plans.query import compile_count, compile_get
from trimodel.sources import catalog, documents, keyspace
from trimodel.sources.store import Manifest, Store, Table

FORMATS = ("csv", "json", "parquet")
DDL = (t.MakeTable, t.MakeIndex, t.MakeNamespace, t.DropTable, t.DropIndex, t.DropNamespace, t.Alter)


@dataclass(frozen=True)
class Outcome:
    """kind: rows, inserted, updated, deleted, created, dropped, altered or executed."""

    kind: str
    count: int | None = None
    rows: DataFrame | None = None


@dataclass
class _Transaction:
    base: Manifest
    now: Manifest
    written: set[str] = field(default_factory=set)
    read_only: bool = False


def object_id() -> Column:
    """24 hex digits: seconds, then what tells rows and sessions apart."""
    return F.lower(F.concat(F.lpad(F.hex(F.unix_timestamp()), 8, "0"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 16)))


class Session:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "trimodel")
        self.namespace = "default"
        self.frames: dict[str, DataFrame] = {}
        self.functions: dict[str, Registered] = {}
        self._store: Store | None = None
        self._tx: _Transaction | None = None

    # sources

    @property
    def store(self) -> Store:
        if self._store is None:
            self._store = Store(self.spark, self.root)
        return self._store

    def register(self, name: str, df: DataFrame) -> None:
        """A frame under a name. Its rows are returned as they are."""
        self.frames[name] = df

    def values(self, name: str, rows: Sequence[Mapping[str, object]]) -> DataFrame:
        """Rows of constants as a relation under a name; a column that a row lacks is NULL in it."""
        columns = list(dict.fromkeys(c for r in rows for c in r))
        kinds = {c: common([literal(r[c]) for r in rows if c in r]) for c in columns}
        schema = T.StructType([T.StructField(c, T.StringType() if isinstance(k, T.NullType) else k) for c, k in kinds.items()])
        fit = lambda v, k: float(v) if isinstance(k, T.DoubleType) and v is not None else v
        self.register(name, self.spark.createDataFrame([tuple(fit(r.get(c), kinds[c]) for c in columns) for r in rows], schema))
        return self.frames[name]

    def load(self, name: str, path: str, kind: str = "parquet", **options: object) -> DataFrame:
        """A csv, json or parquet file or folder under a name."""
        if kind not in FORMATS:
            raise CatalogError(f"no such format: {kind}")
        given = {"header": True, "inferSchema": True} | options if kind == "csv" else options
        self.register(name, self.spark.read.options(**given).format(kind).load(path))
        return self.frames[name]

    def export(self, what: str | DataFrame, path: str, kind: str = "parquet", **options: object) -> None:
        """A table or a query's rows as a folder of csv, json or parquet files; dotted names get underscores in csv."""
        if kind not in FORMATS:
            raise CatalogError(f"no such format: {kind}")
        df = self.frame(what) if isinstance(what, str) else what
        given = {"header": True} | options if kind == "csv" else options
        df.write.options(**given).format(kind).save(path)

    def read_folder(self, folder: str, names: tuple[str, ...]) -> Session:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def register_function(self, name: str, call: Callable, takes: tuple[str, ...], returns: str, kind: str = "arrow", deterministic: bool = True) -> None:
        if name.lower() in BUILTINS:
            raise CatalogError(f"{name} is a built-in function")
        self.functions[name] = Registered(name, call, takes, returns, kind, deterministic)

    def aggregate(self, name: str, df: DataFrame, by: list[str], *columns: str) -> DataFrame:
        """A registered aggregate by keys."""
        f = self.functions[name]
        if f.kind == "states":
            return f.grouped(df, by, columns).withColumnRenamed("tm_out", name)
        values = [Value(F.col(c), df.schema[c].dataType) for c in columns]
        return df.groupBy(*by).agg(f.column(values).alias(name))

    def full(self, name: str) -> str:
        return name if "." in name else f"{self.namespace}.{name}"

    def frame(self, name: str) -> DataFrame:
        """What a query reads under a name: a registered frame, or a managed table's visible rows."""
        if name in self.frames:
            return self.frames[name]
        manifest = self._manifest()
        if self.full(name) not in manifest.tables:
            raise CatalogError(f"no table {self.full(name)}")
        return self._visible(manifest.tables[self.full(name)])

    def _visible(self, table: Table) -> DataFrame:
        rows = self.store.read(table)
        if table.model == "document":
            return documents.latest(rows).drop(*documents.SYSTEM[1:])
        if table.model == "keyspace":
            return keyspace.live(rows).drop("_expires_at")
        return with_id(rows)

    def log(self, name: str) -> DataFrame:
        """All revisions of a document table, or all rows of a keyspace with their expiry."""
        return self.store.read(catalog.find(self._manifest(), self.full(name)))

    def table(self, name: str) -> Relation:
        return Relation(self.frame(name), functions=self.functions)

    # queries

    def execute(self, text: str, *params: object, **named: object) -> list[Outcome]:
        bound = {**{k + 1: p for k, p in enumerate(params)}, **named}
        return [self._run(s, bound) for s in parse(text)]

    def query(self, text: str, *params: object, **named: object) -> DataFrame:
        """The rows of the last statement."""
        outcomes = self.execute(text, *params, **named)
        if not outcomes or outcomes[-1].rows is None:
            raise CompileError("the last statement gives no rows")
        return outcomes[-1].rows

    def batch(self, *texts: str) -> list[Outcome]:
        return [o for text in texts for o in self.execute(text)]

    def optional(self, text: str, *params: object, **named: object):
        rows = self.query(text, *params, **named).limit(2).collect()
        if len(rows) > 1:
            raise CardinalityError("more than one row")
        return rows[0] if rows else None

    def one(self, text: str, *params: object, **named: object):
        row = self.optional(text, *params, **named)
        if row is None:
            raise CardinalityError("no row")
        return row

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    def list_tables(self, namespace: str | None = None) -> DataFrame:
        return catalog.list_tables(self.spark, self._manifest(), namespace)

    def list_namespaces(self) -> DataFrame:
        return catalog.list_namespaces(self.spark, self._manifest())

    def stats(self, name: str) -> DataFrame:
        """Rows and parts of a managed table."""
        table = catalog.find(self._manifest(), self.full(name))
        return self._visible(table).agg(F.count(F.lit(1)).alias("rows")).withColumn("parts", F.lit(len(table.parts)))

    def _run(self, s: object, params: Mapping) -> Outcome:
        if isinstance(s, t.Get):
            return Outcome("rows", rows=compile_get(s, self.frame, params, self.functions))
        if isinstance(s, t.Count):
            return Outcome("rows", rows=compile_count(s, self.frame, params, self.functions))
        if isinstance(s, t.Describe):
            return Outcome("rows", rows=self._describe(s.table))
        if isinstance(s, t.Transaction):
            {"begin": self.begin, "commit": self.commit, "rollback": self.rollback}[s.verb]()
            return Outcome("executed")
        if isinstance(s, t.Use):
            if s.namespace not in self._manifest().namespaces:
                raise CatalogError(f"no namespace {s.namespace}")
            self.namespace = s.namespace
            return Outcome("executed")
        if isinstance(s, DDL):
            return self._define(s)
        return self._mutate(s, params)

    def _describe(self, name: str) -> DataFrame:
        if name in self.frames:
            columns = [catalog.Column(f.name, catalog_type(f.dataType), False, False, not f.nullable) for f in self.frames[name].schema.fields]
            return catalog.describe(self.spark, Table(name, "external", columns))
        return catalog.describe(self.spark, catalog.find(self._manifest(), self.full(name)))

    # transactions

    def _manifest(self) -> Manifest:
        return self._tx.now if self._tx else self.store.latest()

    def begin(self, read_only: bool = False) -> None:
        if self._tx:
            raise TransactionError("a transaction is open")
        base = self.store.latest()
        self._tx = _Transaction(base, copy.deepcopy(base), read_only=read_only)

    def commit(self) -> None:
        tx = self._open()
        try:
            while tx.written:
                latest = self.store.latest()
                for name in tx.written:  # the first committer wins
                    if _state(latest, name) != _state(tx.base, name):
                        raise TransactionError(f"{name} was changed by another session")
                for name in tx.written:
                    if name.startswith("namespace "):
                        _set(latest.namespaces, name[10:], tx.now.namespaces)
                    else:
                        _set(latest.tables, name, tx.now.tables)
                with contextlib.suppress(TransactionError):
                    self.store.commit(latest)
                    break
        finally:
            self._tx = None

    def rollback(self) -> None:
        self._open()
        self._tx = None

    def _open(self) -> _Transaction:
        if not self._tx:
            raise TransactionError("no transaction is open")
        return self._tx

    @contextlib.contextmanager
    def transaction(self, read_only: bool = False) -> Iterator[Session]:
        self.begin(read_only)
        try:
            yield self
        except BaseException:
            self._tx = None
            raise
        self.commit()

    def _apply(self, names: list[str], change: Callable[[Manifest], object], at_once: bool = False):
        """A change of the manifest: in the open transaction, or committed by itself, again if another came first."""
        if self._tx and self._tx.read_only:
            raise TransactionError("the transaction is read-only")
        if self._tx and not at_once:
            out = change(self._tx.now)
            self._tx.written.update(names)
            return out
        while True:
            manifest = self.store.latest()
            out = change(manifest)
            try:
                self.store.commit(manifest)
            except TransactionError:
                continue
            if self._tx:  # documents and keyspaces aren't transactional: what they wrote is seen at once
                for n in names:
                    for m in (self._tx.now, self._tx.base):
                        _set(m.tables, n, manifest.tables)
            return out

    # definitions

    def _define(self, s: object) -> Outcome:
        if getattr(s, "quiet", False) and self._is_there(s) == isinstance(s, (t.MakeTable, t.MakeIndex, t.MakeNamespace)):
            return Outcome("executed")
        if isinstance(s, t.MakeNamespace):
            self._apply([f"namespace {s.name}"], lambda m: catalog.make_namespace(m, s))
            return Outcome("created")
        if isinstance(s, t.DropNamespace):
            inside = [n for n in self._manifest().tables if n.startswith(f"{s.name}.")]
            self._apply([f"namespace {s.name}", *inside], lambda m: catalog.drop_namespace(m, s))
            return Outcome("dropped")
        name = self.full(s.table if isinstance(s, (t.MakeIndex, t.DropIndex, t.Alter)) else s.name)
        if isinstance(s, t.MakeTable):
            self._apply([name], lambda m: catalog.make_table(m, name, s))
            return Outcome("created")
        if isinstance(s, t.DropTable):
            self._apply([name], lambda m: catalog.drop_table(m, name))
            return Outcome("dropped")
        if isinstance(s, t.MakeIndex):
            if s.unique:
                self._unique(self._visible(catalog.find(self._manifest(), name)), list(s.columns))
            self._apply([name], lambda m: catalog.make_index(m, name, s))
            return Outcome("created")
        if isinstance(s, t.DropIndex):
            self._apply([name], lambda m: catalog.drop_index(m, name, s))
            return Outcome("dropped")
        return self._alter(name, s)

    def _is_there(self, s: object) -> bool:
        m = self._manifest()
        if isinstance(s, (t.MakeNamespace, t.DropNamespace)):
            return s.name in m.namespaces
        table = m.tables.get(self.full(s.table if isinstance(s, (t.MakeIndex, t.DropIndex)) else s.name))
        return table is not None and (isinstance(s, (t.MakeTable, t.DropTable)) or any(i.name == s.name for i in table.indexes))

    def _alter(self, name: str, s: t.Alter) -> Outcome:
        to = next((self.full(w) for step, w in s.steps if step == "rename table"), name)

        def change(m: Manifest) -> None:
            table = catalog.find(m, name)
            rows = self.store.read(table)
            new, after = catalog.alter(table, [x for x in s.steps if x[0] != "rename table"], rows, self._default)
            for step, what in s.steps:
                if step == "required" and after.filter(F.col(what[0]).isNull()).limit(1).count():
                    raise ConstraintError(f"{what[0]} has NULLs")
            if after.schema != rows.schema:
                new.schema = after.schema.json()
                new.parts = [self.store.write(after)] if table.parts else []
            new.version += 1
            if to != name and to in m.tables:
                raise CatalogError(f"table {to} exists")
            del m.tables[name]
            new.name = to
            m.tables[to] = new

        self._apply([name, to], change)
        return Outcome("altered")

    def _default(self, column: catalog.Column) -> Column:
        if column.default is None:
            return F.lit(None)
        scope = compiler.Scope(T.StructType([]), functions=self.functions)
        return compiler.compile_value(catalog.load_expr(column.default), scope).col

    # mutations

    def _mutate(self, s: t.Put | t.Change | t.Remove, params: Mapping) -> Outcome:
        name = self.full(s.table)
        table = catalog.find(self._manifest(), name)
        if isinstance(s, t.Put):
            scope = compiler.Scope(T.StructType([]), params=params, functions=self.functions)
            values = {n: compiler.compile_value(e, scope) for n, e in s.values}
            rows = self.spark.range(1).select(*[_storable(v).alias(n) for n, v in values.items()])
            return Outcome("inserted", self.put(s.table, rows))
        at_once = table.model != "relational"
        if isinstance(s, t.Change):
            n = self._apply([name], lambda m: self._rewrite(m, name, s.where, s.values, params), at_once)
            return Outcome("updated", n)
        n = self._apply([name], lambda m: self._rewrite(m, name, s.where, None, params), at_once)
        return Outcome("deleted", n)

    def put(self, name: str, rows: DataFrame) -> int:
        """Rows into a managed table: one statement's row, or a frame of any size."""
        full = self.full(name)
        model = catalog.find(self._manifest(), full).model
        put = {"relational": self._put_relational, "document": self._put_document, "keyspace": self._put_keyspace}[model]
        return self._apply([full], lambda m: put(m.tables[full], rows), model != "relational")

    def _put_relational(self, table: Table, rows: DataFrame) -> int:
        fixed = rows.select([c for c in rows.columns if c in {x.name for x in table.columns}])
        base = self.store.read(table)
        primary = [c for c in table.columns if c.primary]
        for c in table.columns:
            kind = table.struct[c.name].dataType
            if c.name in fixed.columns:
                fixed = fixed.withColumn(c.name, F.col(c.name).cast(kind))
            elif primary == [c] and c.type in ("int32", "int64", "float32", "float64") and c.default is None:
                last = base.agg(F.max(c.name)).first()[0] or 0
                fixed = fixed.withColumn("tm_n", F.monotonically_increasing_id())
                fixed = _ranked(fixed, "tm_n").withColumn(c.name, (F.lit(last) + F.col("tm_rank")).cast(kind)).drop("tm_n", "tm_rank")
            else:
                fixed = fixed.withColumn(c.name, self._default(c).cast(kind))
        fixed = fixed.select(*[f.name for f in table.struct.fields])
        part = self.store.write(fixed)  # settled: uuid() and now() are evaluated once
        new = self.spark.read.schema(table.struct).parquet(f"{self.store.root}/{part}")
        for c in table.columns:
            if (c.required or c.primary) and new.filter(F.col(c.name).isNull()).limit(1).count():
                raise ConstraintError(f"{c.name} is required")
        key = row_key([f.name for f in table.struct.fields])
        self._unique(new, [key])
        for i in table.indexes:
            if i.unique:
                others = self.store.read(table).join(new.select(F.col(key).alias("tm_key")), F.col(key).eqNullSafe(F.col("tm_key")), "left_anti")
                self._unique(others.unionByName(new).filter(F.col(i.columns[0]).isNotNull()), i.columns, new)
        self._make_way(table, new, key, part)
        return new.count()

    def _make_way(self, table: Table, new: DataFrame, key: str, part: str) -> None:
        """The part that holds new added; rows with its keys go. One job finds the parts they are in, one rewrites those."""
        rows = self.store.read(table, named=True)
        hit = {r[0] for r in rows.join(new.select(key), key, "left_semi").select("tm_part").distinct().collect()} if table.parts else set()
        if hit:
            old = self.store.read(table, [p for p in table.parts if p in hit])
            kept = self.store.write(old.join(new.select(F.col(key).alias("tm_key")), F.col(key).eqNullSafe(F.col("tm_key")), "left_anti"))
            table.parts = [*(p for p in table.parts if p not in hit), kept]
        table.parts.append(part)
        self.store.merged(table)
        table.version += 1

    def _unique(self, df: DataFrame, columns: list[str], touched: DataFrame | None = None) -> None:
        if touched is not None:  # only values that come in can be double now
            df = df.join(touched.select(*columns).distinct(), columns, "left_semi")
        if df.groupBy(*columns).count().filter("count > 1").limit(1).count():
            raise ConstraintError(f"{', '.join(columns)} must be unique")

    def _extended(self, table: Table, rows: DataFrame, system: T.StructType) -> None:
        """The table's schema with the fields that rows have beyond it. Numbers widen; where types differ otherwise, the
        field becomes a variant, in which each row keeps its own."""
        fields = {f.name: f for f in table.struct.fields}
        for f in rows.schema.fields:
            old = fields.get(f.name)
            if old is None:
                fields[f.name] = T.StructField(f.name, f.dataType)
            elif old.dataType != f.dataType and old.name not in system.names:
                merged = _merged(old.dataType, f.dataType)
                if merged != old.dataType:
                    fields[f.name] = T.StructField(f.name, merged)
                    parts = self.store.read(table)
                    if table.parts:
                        table.parts = [self.store.write(parts.withColumn(f.name, _as(F.col(f"`{f.name}`"), old.dataType, merged)))]
        table.schema = T.StructType(list(fields.values())).json()

    def _put_document(self, table: Table, rows: DataFrame) -> int:
        if "_id" not in rows.columns:
            rows = rows.withColumn("_id", F.col("id").cast("string") if "id" in rows.columns else object_id())
        rows = self._defaulted(table, rows).withColumn("_id", F.col("_id").cast("string"))
        now = F.current_timestamp()
        rows = rows.drop(*documents.SYSTEM[1:]).withColumns({"_revision": F.lit(1).cast("long"), "_deleted": F.lit(False), "_created_at": now, "_updated_at": now})
        self._extended(table, rows, catalog.DOCUMENT)
        part = self.store.write(_shaped(rows, table.struct))
        new = self.spark.read.schema(table.struct).parquet(f"{self.store.root}/{part}")
        self._unique(new, ["_id"])
        log = self.store.read(table)
        old = documents.latest(log.join(new.select("_id"), "_id", "left_semi"), with_deleted=True)
        if old.filter(~F.col("_deleted")).limit(1).count():
            raise ConstraintError("a document with this _id exists")
        if old.limit(1).count():  # deleted before: the revisions go on
            last = old.select("_id", F.col("_revision").alias("tm_last"))
            revived = new.join(last, "_id", "left").withColumn("_revision", F.coalesce(F.col("tm_last"), F.lit(0)) + 1).select(*new.columns)
            part = self.store.write(revived)
        table.parts, table.version = [*table.parts, part], table.version + 1
        self.store.merged(table)
        return new.count()

    def _put_keyspace(self, table: Table, rows: DataFrame) -> int:
        if "_id" not in rows.columns:
            source = next((c for c in ("id", "key") if c in rows.columns), None)
            rows = rows.withColumn("_id", F.col(source).cast("string") if source else object_id())
        rows = self._defaulted(table, rows).withColumn("_id", F.col("_id").cast("string"))
        if "_expires_at" not in rows.columns:
            rows = rows.withColumn("_expires_at", keyspace.now_ms() + table.ttl * 1000 if table.ttl else F.lit(0).cast("long"))
        self._extended(table, rows, catalog.KEYSPACE)
        part = self.store.write(_shaped(rows, table.struct))
        new = self.spark.read.schema(table.struct).parquet(f"{self.store.root}/{part}")
        self._unique(new, ["_id"])
        self._make_way(table, new, "_id", part)
        return new.count()

    def _defaulted(self, table: Table, rows: DataFrame) -> DataFrame:
        for c in table.columns:
            if c.name not in rows.columns:
                if c.required and c.default is None:
                    raise ConstraintError(f"{c.name} is required")
                rows = rows.withColumn(c.name, self._default(c).cast(table.struct[c.name].dataType))
        return rows

    def _rewrite(self, m: Manifest, name: str, where: t.Expr | None, values: t.Assignments | None, params: Mapping) -> int:
        """A change (values) or removal of the matching rows; the count of rows that matched."""
        table = catalog.find(m, name)
        if table.model == "document":
            return self._revise(table, where, values, params)
        rows = self.store.read(table, named=True)
        seen = with_id(rows) if table.model == "relational" else rows
        matching = seen.filter(mutate.matched(seen, where, params, self.functions))
        if table.model == "keyspace":
            matching = keyspace.live(matching)
        hit = {r["tm_part"]: r["count"] for r in matching.groupBy("tm_part").count().collect()} if table.parts else {}
        if not hit:
            return 0
        old = self.store.read(table, [p for p in table.parts if p in hit])
        after = mutate.changed(old, where, values, params, self.functions) if values is not None else mutate.removed(old, where, params, self.functions)
        if values is not None:
            known = {f.name for f in table.struct.fields}
            table.schema = T.StructType([*table.struct.fields, *(f for f in after.schema.fields if f.name not in known)]).json()
        table.parts = [*(p for p in table.parts if p not in hit), self.store.write(_shaped(after, table.struct))]
        self.store.merged(table)
        table.version += 1
        return sum(hit.values())

    def _revise(self, table: Table, where: t.Expr | None, values: t.Assignments | None, params: Mapping) -> int:
        """New revisions (or tombstones) of the matching documents."""
        now = documents.latest(self.store.read(table))
        hit = now.filter(mutate.matched(now, where, params, self.functions))
        if values is not None:
            hit = mutate.changed(hit, None, values, params, self.functions)
        hit = hit.withColumns({"_revision": F.col("_revision") + 1, "_updated_at": F.current_timestamp(), "_deleted": F.lit(values is None)})
        self._extended(table, hit, catalog.DOCUMENT)
        part = self.store.write(_shaped(hit, table.struct))
        n = self.spark.read.schema(table.struct).parquet(f"{self.store.root}/{part}").count()
        if n:
            table.parts, table.version = [*table.parts, part], table.version + 1
            self.store.merged(table)
        return n

    # documents and keys

    def update_document(self, name: str, key: str, values: dict, revision: int | None = None) -> int:
        """A document's new revision; ConstraintError if its revision isn't the one given."""
        full = self.full(name)

        def change(m: Manifest) -> int:
            table = catalog.find(m, full)
            row = documents.latest(self.store.read(table).filter(F.col("_id") == key)).select("_revision").first()
            if row is None:
                raise ConstraintError(f"no document {key}")
            if revision is not None and row[0] != revision:
                raise ConstraintError(f"{key} is at revision {row[0]}, not {revision}")
            where = t.Binary("=", t.Path(("_id",)), t.Literal(key))
            self._revise(table, where, tuple((k, _tree(v)) for k, v in values.items()), {})
            return row[0] + 1

        return self._apply([full], change, True)

    def upsert_document(self, name: str, key: str, values: dict) -> int:
        found = documents.latest(self.log(name).filter(F.col("_id") == key)).limit(1).count()
        if found:
            return self.update_document(name, key, values)
        row = {"_id": key, **values}
        self.put(name, self.spark.range(1).select(*[literal(v).col.alias(k) for k, v in row.items()]))
        return 1

    def history(self, name: str, key: str, limit: int | None = None) -> DataFrame:
        return documents.history(self.log(name), key, limit)

    def at_revision(self, name: str, key: str, number: int) -> DataFrame:
        return documents.exactly(self.log(name), key, number)

    def purge(self, name: str, before: object) -> None:
        """Drop documents that were deleted before a time."""
        self._replace(name, lambda log: documents.purged(log, before))

    def compact(self, name: str) -> None:
        """A table's parts as one."""
        self._replace(name, lambda rows: rows)

    def vacuum(self, keep: int = 1, older_ms: int = 3_600_000) -> int:
        """Delete what no recent manifest lists; see the store."""
        return self.store.vacuum(keep, older_ms)

    def key_set(self, name: str, key: str, ttl_ms: int | None = None, **values: object) -> None:
        rows = self.spark.range(1).select(F.lit(key).alias("_id"), *[literal(v).col.alias(k) for k, v in values.items()])
        if ttl_ms is not None:
            rows = rows.withColumn("_expires_at", keyspace.now_ms() + ttl_ms)
        self.put(name, rows)

    def key_get(self, name: str, key: str) -> DataFrame:
        return self.frame(name).filter(F.col("_id") == key)

    def key_exists(self, name: str, key: str) -> bool:
        return self.key_get(name, key).limit(1).count() > 0

    def key_delete(self, name: str, key: str) -> int:
        where = t.Binary("=", t.Path(("_id",)), t.Literal(key))
        return self._apply([self.full(name)], lambda m: self._rewrite(m, self.full(name), where, None, {}), True)

    def key_ttl(self, name: str, key: str) -> int | None:
        """Milliseconds left; None for a key that is absent or never expires."""
        row = keyspace.ttl(keyspace.live(self.log(name)).filter(F.col("_id") == key)).select("ttl_ms").first()
        return row[0] if row else None

    def key_expire(self, name: str, key: str, ttl_ms: int) -> None:
        self._replace(name, lambda rows: keyspace.expire(rows, F.col("_id") == key, ttl_ms), F.col("_id") == key)

    def key_persist(self, name: str, key: str) -> None:
        self._replace(name, lambda rows: keyspace.persist(rows, F.col("_id") == key), F.col("_id") == key)

    def cleanup(self, name: str) -> None:
        """Drop expired keys from the files."""
        self._replace(name, keyspace.live, (F.col("_expires_at") > 0) & (keyspace.now_ms() > F.col("_expires_at")))

    def _replace(self, name: str, change: Callable[[DataFrame], DataFrame], hits: Column | None = None) -> None:
        """The table's rows after a change; hits: only parts with rows that meet it are rewritten."""

        def apply(m: Manifest) -> None:
            table = catalog.find(m, self.full(name))
            old = table.parts
            if hits is not None and old:
                found = {r[0] for r in self.store.read(table, named=True).filter(hits).select("tm_part").distinct().collect()}
                old = [p for p in old if p in found]
            if old:
                table.parts = [*(p for p in table.parts if p not in set(old)), self.store.write(change(self.store.read(table, old)))]
                table.version += 1

        self._apply([self.full(name)], apply, True)


def catalog_type(kind: T.DataType) -> str:
    from trimodel.functions.builtins import type_name

    return type_name(kind)


def _state(m: Manifest, name: str) -> object:
    if name.startswith("namespace "):
        return name[10:] in m.namespaces
    table = m.tables.get(name)
    return table and (table.version, table.parts, table.schema)


def _set(to: dict, name: str, source: dict) -> None:
    if name in source:
        to[name] = copy.deepcopy(source[name])
    else:
        to.pop(name, None)


def _tree(value: object) -> t.Expr:
    if isinstance(value, dict):
        return t.ObjectOf(tuple((k, _tree(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return t.ArrayOf(tuple(_tree(v) for v in value))
    return t.Literal(value)


def _storable(v: Value) -> Column:
    """NULL literals as text: Parquet has no void column."""
    return v.col.cast("string") if v.is_(T.NullType) else v.col


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    numbers = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        return T.LongType() if isinstance(a, T.LongType) and isinstance(b, T.IntegerType) or isinstance(a, T.IntegerType) and isinstance(b, T.LongType) else T.DoubleType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f for f in a.fields}
        for f in b.fields:
            fields[f.name] = T.StructField(f.name, _merged(fields[f.name].dataType, f.dataType) if f.name in fields and fields[f.name].dataType != f.dataType else f.dataType)
        return T.StructType(list(fields.values()))
    return T.VariantType()


def _as(col: Column, old: T.DataType, new: T.DataType) -> Column:
    if old == new:
        return col
    if isinstance(new, T.StructType) and isinstance(old, T.StructType):
        inner = [(_as(col.getField(f.name), old[f.name].dataType, f.dataType) if f.name in old.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(col.isNotNull(), F.struct(*inner))
    if isinstance(new, T.VariantType) and isinstance(old, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(col)
    if isinstance(new, T.StringType) and isinstance(old, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast(new)


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of a schema, in its types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(_as(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """With `tm_rank` from 1, by row numbers inside tasks and the tasks' counts: no task sees all rows."""
    from pyspark.sql import Window

    inside = df.withColumn("tm_p", F.shiftright(F.col(order), 33)).withColumn("tm_i", F.row_number().over(Window.partitionBy("tm_p").orderBy(order)))
    counts = inside.groupBy("tm_p").agg(F.count(F.lit(1)).alias("tm_c"))
    before = counts.withColumn("tm_b", F.sum("tm_c").over(Window.orderBy("tm_p").rowsBetween(Window.unboundedPreceding, -1))).drop("tm_c")
    return inside.join(F.broadcast(before), "tm_p").withColumn("tm_rank", F.col("tm_i") + F.coalesce("tm_b", F.lit(0))).drop("tm_p", "tm_i", "tm_b")
