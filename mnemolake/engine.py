"""The knowledge base: one folder of tables with memories, a graph, notes and vectors, and every operation on them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.functions.memory import LifecyclePolicy
from mnemolake.operators import embedding, fulltext, graph, lifecycle, reads, vectorsearch
from mnemolake.operators.reads import NotFound
from mnemolake.plans import presets
from mnemolake.plans.hybrid import HybridSearch
from mnemolake.sources.chunking import chunk_text
from mnemolake.sources.tables import SCHEMAS, Conflict, Tables, _fields

KINDS = ("memory", "entity", "relation", "event", "note", "chunk")
TARGETS = {"memory": ("memory",), "graph": ("entity", "relation", "event"), "notes": ("chunk",)}
Filter = dict[str, Any]


def _identity(value: str, what: str) -> str:
    if not value or value != value.strip() or any(ord(c) < 32 or ord(c) == 127 for c in value):
        raise ValueError(f"{what} must be trimmed text without control characters")
    return value


class KnowledgeBase:
    """Opens (and makes) a knowledge base under ``path``.

    ``namespace`` and ``scopes`` are the default filter of reads, ``write_scope`` the default scope of writes. Every write
    commits a new revision; readers of an older one are not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str = "default", scopes: Sequence[str] = ("public",), write_scope: str = "public") -> None:
        self.spark, self.tables = spark, Tables(spark, path)
        self.namespace, self.scopes, self.write_scope = namespace, list(scopes), write_scope
        self.memories, self.graph, self.notes, self.embeddings = Memories(self), Graph(self), Notes(self), Embeddings(self)
        self._embedder: tuple[str, embedding.Model, int, int | None] | None = None
        self._reranker: Callable | None = None
        self._sink: Callable | None = None
        self._closed = False

    # Reading.

    def table(self, kind: str) -> DataFrame:
        if self._closed:
            raise RuntimeError("the knowledge base is closed")
        return self.tables.read(kind)

    def where(self, given: Filter | None = None) -> Column:
        """The condition of a read filter: namespace, any of the scopes, all of the tags."""
        given = {"namespace": self.namespace, "scopes": self.scopes, "tags": [], **(given or {})}
        if not given["scopes"]:
            raise ValueError("a filter needs a scope")
        return fulltext.text_filter(_identity(given["namespace"], "namespace"), [_identity(s, "scope") for s in given["scopes"]], tags=list(given["tags"]))

    def page(self, kind: str, filter: Filter | None, limit: int, after: str | None, ids_only: bool = False) -> dict:
        if after is not None and not str(after).isdigit():
            raise ValueError("the cursor is not one of this table")
        rows = reads.page(self.table(kind), limit, int(after) if after is not None else None, self.where(filter), ["id"] if ids_only else None)
        items = [r["id"] if ids_only else r.asDict(recursive=True) for r in rows.collect()]
        last = items[-1] if items else None
        more = len(items) == limit
        return {"items": items, "next_cursor": str(last if ids_only else last["id"]) if more else None}

    def one(self, kind: str, key: int | str, filter: Filter | None = None) -> dict:
        return reads.get(self.table(kind), int(key), self.where(filter)).first().asDict(recursive=True)

    # Writing.

    def header(self, kind: str, given: dict, previous: dict | None, now: int) -> dict:
        tags = sorted({t for t in (" ".join(T.normalize_query(t).split()) for t in given.get("tags", (previous or {}).get("tags") or [])) if t})
        created = given.get("created_at_us") or (previous or {}).get("created_at_us") or now
        if previous and given.get("created_at_us") not in (None, previous["created_at_us"]):
            raise ValueError("created_at_us does not change")
        updated = given.get("updated_at_us") or max(now, (previous or {}).get("updated_at_us") or created)
        if updated < created:
            raise ValueError("updated_at_us must not lie before created_at_us")
        if given.get("expected_revision") is not None and (not previous or previous["revision"] != given["expected_revision"]):
            raise Conflict("the record has moved on")
        evidence = list(given.get("evidence") or [])
        for e in evidence:
            if not e.get("source") or (e.get("offset") is None) != (e.get("limit") is None) or (e.get("offset") is not None and min(e["offset"], e["limit"]) < 1):
                raise ValueError("evidence needs a source, and offset and limit from 1 together")
        return {
            "namespace": _identity(given.get("namespace") or self.namespace, "namespace"), "scope": _identity(given.get("scope") or self.write_scope, "scope"), "kind": kind, "tags": tags,
            "evidence": json.dumps(evidence, ensure_ascii=False), "metadata": json.dumps(given.get("metadata") or {}, ensure_ascii=False), "created_at_us": created, "updated_at_us": updated,
        }

    def put(self, kind: str, inputs: Sequence[dict], body: Callable[[dict, dict | None], dict], extra: dict[str, DataFrame] | None = None) -> list[dict]:
        """Inserts or updates records of one kind in one commit."""
        known = self.existing(kind, [int(i["id"]) for i in inputs if i.get("id") is not None])
        now, next_id, revision = time.time_ns() // 1000, self.tables.manifest["next_id"], self.tables.manifest["revision"] + 1
        rows: dict[int, dict] = {}
        for given in inputs:
            previous = None
            if given.get("id") is not None:
                previous = rows.get(int(given["id"])) or known.get(int(given["id"]))
                if previous is None:
                    raise NotFound(given["id"])
            record_id = int(given["id"]) if previous else next_id
            next_id += previous is None
            rows[record_id] = {"id": record_id, **self.header(kind, given, previous, now), "revision": revision, **body(given, previous)}
        if rows:
            frame = self.spark.createDataFrame([tuple(r[c] for c in self._columns(kind)) for r in rows.values()], SCHEMAS[kind])
            changed = {kind: lifecycle.put_records(self.table(kind), frame), **(extra or {})}
            stale = frame.select("id")
            if kind != "note" and "vector" in self.tables.manifest["versions"]:
                changed["vector"] = self.table("vector").join(stale, "id", "left_anti")
            self.tables.commit(changed, next_id=next_id)
        return list(rows.values())

    @staticmethod
    def _columns(kind: str) -> list[str]:
        return [f.split()[0] for f in _fields(SCHEMAS[kind])]

    def existing(self, kind: str, ids: Sequence[int]) -> dict[int, dict]:
        if not ids:
            return {}
        wanted = self.spark.createDataFrame([(i,) for i in set(ids)], "id long")
        return {r["id"]: r.asDict(recursive=True) for r in reads.load_many(self.table(kind), wanted).collect()}

    def remove(self, kind: str, ids: Sequence[int | str], filter: Filter | None) -> int:
        """Deletes records; only the filter's tags count. Chunks go with their note, vectors with their record."""
        wanted = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        tags = fulltext.text_filter(tags=list((filter or {}).get("tags", [])))
        doomed = reads.load_many(self.table(kind), wanted, tags).select("id")
        if kind == "entity":
            people = self.table("event").select(F.col("id").alias("event_id"), F.explode("participants").alias("entity_id"))
            if not lifecycle.blocked_by_reference(doomed, self.table("relation"), people).isEmpty():
                raise Conflict("relations or events refer to it")
        changed = {kind: self.table(kind).join(doomed, "id", "left_anti")}
        gone = doomed
        if kind == "note":
            parts = self.table("chunk").join(doomed.toDF("note_id"), "note_id", "left_semi").select("id")
            changed["chunk"] = self.table("chunk").join(doomed.toDF("note_id"), "note_id", "left_anti")
            gone = doomed.union(parts)
        count = gone.count()
        if count:
            if "vector" in self.tables.manifest["versions"]:
                changed["vector"] = self.table("vector").join(gone, "id", "left_anti")
            self.tables.commit(changed)
        return count

    def setting(self, name: str, default: Any = None) -> Any:
        return self.tables.manifest["settings"].get(name, default)

    def set_setting(self, name: str, value: Any) -> int:
        settings = dict(self.tables.manifest["settings"])
        settings.pop(name, None)
        if value is not None:
            settings[name] = value
        return self.tables.commit(settings=settings)

    # Text and vectors of records, derived when read, so nothing goes stale.

    def texts(self) -> DataFrame:
        """id, namespace, scope, kind, tags, note_id, text, name, path, embed: what of each record is searched and embedded."""
        head = ("id", "namespace", "scope", "kind", "tags")
        none, empty = F.lit(None).cast("long").alias("note_id"), F.lit("")
        rows = []
        memory = self.table("memory")
        listed = F.array_join("tags", " ")
        rows.append(memory.select(*head, none, F.col("judgment").alias("text"), empty.alias("name"), empty.alias("path"), F.when(F.size("tags") > 0, F.concat("judgment", F.lit("\n"), listed)).otherwise(F.col("judgment")).alias("embed")))
        entity = self.table("entity")
        body = T.entity_body(F.col("aliases"), F.col("summary"), F.col("attributes"))
        rows.append(entity.select(*head, none, body.alias("text"), "name", empty.alias("path"), F.concat("name", F.lit("\n"), body).alias("embed")))
        names = entity.select("id", "name")
        relation = self.table("relation").join(names.toDF("src", "subject"), "src", "left").join(names.toDF("dst", "object"), "dst", "left")
        sentence = F.concat_ws(" ", "subject", "predicate", "object", "reason")
        rows.append(relation.select(*head, none, sentence.alias("text"), empty.alias("name"), empty.alias("path"), sentence.alias("embed")))
        people = self.table("event").select(F.col("id").alias("event_id"), F.explode("participants").alias("pid")).join(names.toDF("pid", "who"), "pid")
        people = people.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pid", "who"))).alias("p"))
        event = self.table("event").join(people, F.col("id") == F.col("event_id"), "left")
        told = F.concat_ws(" ", "name", "summary", F.array_join(F.transform("p", lambda x: x["who"]), " "), "reason")
        rows.append(event.select(*head, none, told.alias("text"), empty.alias("name"), empty.alias("path"), told.alias("embed")))
        notes = self.table("note").select(F.col("id").alias("note_id"), "path", "title")
        chunk = self.table("chunk").join(notes, "note_id")
        first = F.col("ordinal") == 0
        own = F.array_union(T.tag_set(T.note_dirs("path")), F.array(T.normalized_tag("title")))
        prefix = F.when(first, F.array_join(F.array_except("tags", own), " ")).otherwise("")
        rows.append(chunk.select(
            *head, "note_id", F.when(prefix != "", F.concat(prefix, F.lit("\n"), "content")).otherwise(F.col("content")).alias("text"), F.when(first, F.col("title")).otherwise("").alias("name"),
            F.when(first, F.array_join(T.note_dirs("path"), " ")).otherwise("").alias("path"), F.col("content").alias("embed"),
        ))
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def index(self) -> fulltext.TextIndex:
        return fulltext.TextIndex.build(self.texts().withColumn("text", T.clean_markdown("text")))

    def search(self, query: str = "", *, filter: Filter | None = None, kinds: Sequence[str] = ("memory", "entity", "relation", "event", "chunk"), limit: int = 10, candidate_limit: int | None = None, embed_space: str | None = None, text: bool = True, vector: bool = True, rerank: bool = True, text_weight: float = 1.0, prune: dict | None = None, with_total: bool = False, match_field: str = "all", top_chunks_per_note: int = 3) -> dict:
        """Hybrid search; hits carry their record, and diagnostics say what was used."""
        started = time.perf_counter()
        filter = filter or {}
        where = self.where(filter) & F.col("kind").isin(list(kinds))
        if filter.get("note_ids"):
            where &= fulltext.text_filter(note_ids=list(filter["note_ids"]))
        probe, allow, degraded = None, None, []
        if prune:
            root = int(prune["root"])
            near = self.graph.ego_ids(root, int(prune.get("depth", 1)), filter)
            allow = self.spark.createDataFrame([(i,) for i in [root, *near]], "id long")
        vectors = None
        if vector and self._embedder:
            space, model, _, budget = self._embedder
            space = embed_space or space
            if self.embeddings.ready(space, filter.get("namespace", self.namespace)):
                vectors = self.embeddings.decoded(space)
            else:
                degraded.append("vectors are not complete")
        index = self.index()
        plan = HybridSearch(index, vectors, (lambda q: embedding.embed_patiently(self._embedder[1], [q])[0]) if vectors is not None else None, self._reranker if rerank else None, self.graph.synonyms(filter.get("namespace", self.namespace)))
        documents = self.texts().select("id", F.when(F.col("kind") == "entity", F.concat_ws(" ", "name", "text")).otherwise(F.col("text")).alias("text"))
        rows, notes = plan.search(query, limit, where, probe, text_weight, top_chunks_per_note, documents, candidate_limit=candidate_limit, match_field=match_field, text=text, allow=allow)
        notes.degraded += degraded
        hits = [r.asDict() for r in rows.collect()]
        kinds_of = {r["id"]: r["kind"] for r in index.tokens.select("id", "kind").join(self.spark.createDataFrame([(h["id"],) for h in hits], "id long"), "id", "left_semi").collect()}
        loaded: dict[int, dict] = {}
        for kind in set(kinds_of.values()):  # records are joined after the limit; what vanished meanwhile is dropped
            loaded |= self.existing(kind, [i for i, k in kinds_of.items() if k == kind])
        counts = {}
        if found := [h["note_id"] for h in hits if h["note_id"] is not None]:
            if match_field in ("all", "text"):
                counts = {r["note_id"]: r["chunks"] for r in fulltext.note_counts(index, query, self.spark.createDataFrame([(i,) for i in found], "note_id long")).collect()}
        items = [{"id": h["id"], "score": h["score"], "record": loaded[h["id"]], "top_chunks": list(h["top_chunks"] or []), "note_chunks": counts.get(h["note_id"])} for h in hits if h["id"] in loaded]
        total = None
        if with_total:
            total = sum(self.table(k).where(self.where({**filter, "note_ids": []})).count() for k in kinds)
        elapsed = int((time.perf_counter() - started) * 1e6)
        self._emit({"event": "search", "elapsed_us": elapsed, "hits": len(items), "degraded": notes.degraded})
        return {"hits": items, "total": total, "diagnostics": vars(notes)}

    def search_preset(self, preset: str = "rag", query: str = "", *, filter: Filter | None = None, budget: presets.Budget = presets.Budget(), candidate_limit: int = 64) -> dict:
        """The routes of a preset, each with its own budget; scores of routes are never mixed."""
        if preset not in presets.ROUTES:
            raise ValueError(f"no preset {preset}")
        out: dict[str, Any] = {}
        index, texts = self.index(), self.texts()
        for route in presets.ROUTES[preset]:
            if route == "graph":
                hits = self.search(query, filter=filter, kinds=("entity",), limit=max(budget.seeds, 1), rerank=False)["hits"]
                seeds = self.spark.createDataFrame([(h["id"],) for h in hits], "id long")
                names = [n for h in hits for n in [h["record"]["name"], *(h["record"]["aliases"] or [])]]
                space = self.where({**(filter or {}), "tags": []})
                people = self.table("event").select(F.col("id").alias("event_id"), F.explode("participants").alias("entity_id"))
                rows = presets.graph_route(seeds, self.table("relation").where(space).select("id", "src", "predicate", "dst"), texts, self.table("event").where(space), people, query, names, budget, self.graph.synonyms((filter or {}).get("namespace", self.namespace)))
                out[route] = [(r["id"], r["part"]) for r in rows.collect()]
            else:
                kind = "memory" if route == "memory" else "chunk"
                part = fulltext.TextIndex(index.tokens.where((F.col("kind") == kind) & self.where(filter)))
                bodies = texts.where(F.col("kind") == kind).select("id", F.col("embed").alias("text"))
                rows = presets.memory_route(part, bodies, query, budget) if route == "memory" else presets.notes_route(part, bodies, query, budget)
                out[route] = [r["id"] for r in rows.orderBy("rank").collect()] if route == "memory" else [(r["id"], r["part"]) for r in rows.orderBy(F.desc("part"), "rank").collect()]
        return out

    def search_with_context(self, query: str, limit: int = 10, per_root: int = 10, **how) -> dict:
        """Search hits with the graph around the entities that their tags name."""
        found = self.search(query, limit=limit, **how)
        tags = [(h["id"], t) for h in found["hits"] for t in h["record"]["tags"] or []]
        rows = graph.mounted(self.spark.createDataFrame(tags, "record_id long, tag string"), self.table("entity").where(self.where()), self.table("relation").where(self.where()), per_root)
        context: dict[int, list] = {}
        for r in rows.orderBy("record_id", "root", "relation_id").collect():
            context.setdefault(r["record_id"], []).append((r["root"], r["relation_id"], r["other"]))
        return {**found, "context": context}

    # Maintenance.

    def counts(self) -> dict[str, int]:
        each = {k: self.table(k).count() for k in KINDS}
        return {**each, "total": sum(each.values())}

    def namespaces(self) -> list[dict]:
        rows = None
        for kind in KINDS:
            one = self.table(kind).select("namespace", F.lit(kind).alias("kind"))
            rows = one if rows is None else rows.union(one)
        return [r.asDict() for r in reads.namespaces(rows).orderBy("namespace").collect()]

    def health(self) -> dict:
        return {"revision": self.tables.manifest["revision"], "indexed_revision": self.tables.manifest["revision"], "counts": self.counts(), "spaces": self.setting("spaces", {}), "closed": self._closed}

    def integrity_check(self) -> str:
        twice = [k for k in KINDS if not self.table(k).groupBy("id").count().where("count > 1").isEmpty()]
        return "ok" if not twice else "repeated ids: " + ", ".join(twice)

    def foreign_key_check(self) -> int:
        people = self.table("event").select(F.col("id").alias("event_id"), F.explode("participants").alias("entity_id"))
        checks = lifecycle.audit(self.table("relation"), people, self.table("entity"), self.table("chunk"), self.table("note"))
        return checks.agg(F.sum("broken")).first()[0]

    def update_index(self) -> dict:
        """The index derives from the tables when read; there is nothing to bring up to date."""
        return {"indexed_revision": self.tables.manifest["revision"], "documents": 0}

    reconcile = update_index

    def backup(self, path: str) -> None:
        self.tables.copy_to(path)

    @classmethod
    def restore(cls, spark: SparkSession, snapshot: str, path: str, **how) -> KnowledgeBase:
        source = Tables(spark, snapshot)
        if not source.manifest["revision"] and not source.folder.exists("manifests"):
            raise ValueError(f"{snapshot} is no snapshot")
        source.copy_to(path)
        return cls(spark, path, **how)

    def import_runs(self) -> dict[str, str]:
        return self.setting("imports", {})

    def import_memories(self, rows: DataFrame, source: str, dry_run: bool = True) -> dict:
        """Takes over foreign memories (as ``importer.map_memories`` gives them); a source already imported as it is, is skipped."""
        from mnemolake.sources.importer import fingerprint

        mark = fingerprint(rows)
        report = {"source": source, "records": rows.count(), "skipped": self.import_runs().get(source) == mark, "dry_run": dry_run}
        if dry_run or report["skipped"]:
            return report
        now, first, revision = time.time_ns() // 1000, self.tables.manifest["next_id"], self.tables.manifest["revision"] + 1
        numbered = rows.orderBy("id").rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, nth long")
        new = numbered.select(
            (F.col("nth") + first).alias("id"), "namespace", "scope", F.lit("memory").alias("kind"), F.array().cast("array<string>").alias("tags"), F.lit("[]").alias("evidence"),
            F.to_json(F.struct(F.lit(source).alias("source"), F.col("id").alias("source_id"))).alias("metadata"), F.lit(now).alias("created_at_us"), F.lit(now).alias("updated_at_us"), F.lit(revision).alias("revision"),
            "memory_type", "judgment", F.lit("").alias("reasoning"), F.lit(False).alias("pinned"), F.lit(1).cast("long").alias("strength"), F.lit(0).cast("long").alias("useful_count"), F.lit(0.0).alias("useful_score"),
            F.lit(None).cast("long").alias("last_recalled_at_us"), F.lit(None).cast("long").alias("last_decay_at_us"),
        )
        settings = {**self.tables.manifest["settings"], "imports": {**self.import_runs(), source: mark}}
        self.tables.commit({"memory": self.table("memory").unionByName(new)}, next_id=first + report["records"], settings=settings)
        return report

    def delete_import_run(self, source: str) -> bool:
        runs = self.import_runs()
        if source not in runs:
            return False
        self.set_setting("imports", {k: v for k, v in runs.items() if k != source})
        return True

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> KnowledgeBase:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    # Host callables.

    def register_embedder(self, space: str, model: embedding.Model, batch: int = 32, max_tokens: int | None = None) -> None:
        if not 1 <= batch <= 10_000:
            raise ValueError("batch must lie between 1 and 10000")
        spaces = self.setting("spaces", {})
        if space not in spaces:
            raise NotFound(space)
        if any(len(v) != spaces[space]["dimension"] for v in model(["probe"])):
            raise ValueError("the model's dimension is not the space's")
        self._embedder = (space, model, batch, max_tokens)

    def register_reranker(self, callback: Callable[[str, list[str]], list[float]] | None) -> None:
        self._reranker = callback

    def register_event_sink(self, sink: Callable[[dict], None] | None) -> None:
        self._sink = sink

    def _emit(self, event: dict) -> None:
        if self._sink:
            try:
                self._sink(event)
            except Exception:  # noqa: BLE001, S110 - a sink must not break a search
                pass

    def invoke(self, operation: str, payload: dict | None = None) -> Any:
        """Any operation by name: ``memories.upsert``, ``graph.ego``, ``search`` and so on."""
        target: Any = self
        for name in operation.split("."):
            if name.startswith("_"):
                raise ValueError(f"no operation {operation}")
            target = getattr(target, name, None)
            if target is None:
                raise ValueError(f"no operation {operation}")
        return target(**(payload or {}))


class _Part:
    def __init__(self, kb: KnowledgeBase) -> None:
        self.kb = kb


class _Kind(_Part):
    kind = ""

    def get(self, id: int | str, filter: Filter | None = None) -> dict:
        return self.kb.one(self.kind, id, filter)

    def list(self, filter: Filter | None = None, limit: int = 50, after: str | None = None) -> dict:
        return self.kb.page(self.kind, filter, limit, after)

    def ids(self, filter: Filter | None = None, limit: int = 50, after: str | None = None) -> dict:
        return self.kb.page(self.kind, filter, limit, after, True)

    def delete(self, ids: Sequence[int | str], filter: Filter | None = None) -> int:
        return self.kb.remove(self.kind, ids, filter)


class Memories(_Kind):
    kind = "memory"

    @staticmethod
    def _body(given: dict, previous: dict | None) -> dict:
        if not (given.get("judgment") or "").strip():
            raise ValueError("a memory needs a judgment")
        start = {"pinned": False, "strength": 1, "useful_count": 0, "useful_score": 0.0, "last_recalled_at_us": None, "last_decay_at_us": None}
        state = {k: (previous or start)[k] for k in start} | (given.get("state") or {})
        if min(state["strength"], state["useful_count"], state["useful_score"]) < 0:
            raise ValueError("lifecycle values are not negative")
        return {"memory_type": given.get("memory_type", "knowledge"), "judgment": given["judgment"].strip(), "reasoning": given.get("reasoning", ""), **state}

    def upsert(self, **given: Any) -> dict:
        return self.upsert_many([given])[0]

    def upsert_many(self, inputs: Sequence[dict]) -> list[dict]:
        return self.kb.put("memory", inputs, self._body)

    def upsert_by_judgment(self, **given: Any) -> dict:
        """Updates the one memory with the same judgment in its namespace and scope, or inserts."""
        scope, key = given.get("scope") or self.kb.write_scope, " ".join(T.normalize_query(given["judgment"]).split())
        space = {"namespace": given.get("namespace") or self.kb.namespace, "scopes": [scope]}
        found = self.kb.table("memory").where(self.kb.where(space) & (T.normalized_tag("judgment") == key)).orderBy("id").limit(2).collect()
        if len(found) > 1:
            raise Conflict("several memories have this judgment")
        if found:
            old = found[0].asDict(recursive=True)
            metadata = {**json.loads(old["metadata"] or "{}"), **(given.get("metadata") or {})}
            evidence = given.get("evidence") or json.loads(old["evidence"] or "[]")
            given = {"tags": old["tags"], **given, "id": old["id"], "metadata": metadata, "evidence": evidence}
        return self.upsert(**given)

    def feedback(self, recalled_ids: Sequence[int], useful_ids: Sequence[int] = (), filter: Filter | None = None, now_us: int | None = None, policy: LifecyclePolicy = LifecyclePolicy()) -> dict:
        ids = [int(i) for i in dict.fromkeys(recalled_ids)]
        rows = self.kb.table("memory")
        wanted = self.kb.spark.createDataFrame([(i,) for i in ids], "id long")
        seen = {r["id"]: r for r in reads.load_many(rows, wanted, self.kb.where(filter)).collect()}
        if missing := [i for i in ids if i not in seen]:
            raise NotFound(missing[0])
        after = lifecycle.feedback_once(rows, ids, [int(i) for i in useful_ids], now_us or time.time_ns() // 1000, policy)
        useful = {int(i) for i in useful_ids}
        middle = lambda r: policy.middle_from <= r["useful_score"] < policy.upper_from
        report = {"recalled": len(ids), "boosted": len(useful), "penalized": sum(1 for i, r in seen.items() if i not in useful and not r["pinned"] and middle(r))}
        self.kb.tables.commit({"memory": after})
        return report

    def decay(self, filter: Filter | None = None, now_us: int | None = None, policy: LifecyclePolicy = LifecyclePolicy()) -> dict:
        rows, inside = self.kb.table("memory"), self.kb.where(filter)
        after = lifecycle.decay(rows.where(inside), now_us or time.time_ns() // 1000, policy)
        self.kb.tables.commit({"memory": rows.where(~inside).unionByName(after.drop("decayed", "candidate"))})
        marked = lifecycle.decay(rows.where(inside), now_us or time.time_ns() // 1000, policy).where("decayed OR candidate").select("id", "decayed", "candidate").orderBy("id").collect()
        return {"decayed": sum(r["decayed"] for r in marked), "retirement_candidates": [r["id"] for r in marked if r["candidate"]]}


class Graph(_Part):
    def _of(self, kind: str) -> _Kind:
        if kind not in ("entity", "relation", "event"):
            raise ValueError("a graph record is an entity, a relation or an event")
        part = _Kind(self.kb)
        part.kind = kind
        return part

    def get(self, kind: str, id: int | str, filter: Filter | None = None) -> dict:
        return self._of(kind).get(id, filter)

    def list(self, kind: str, filter: Filter | None = None, limit: int = 50, after: str | None = None) -> dict:
        return self._of(kind).list(filter, limit, after)

    def ids(self, kind: str, filter: Filter | None = None, limit: int = 50, after: str | None = None) -> dict:
        return self._of(kind).ids(filter, limit, after)

    def delete(self, kind: str, ids: Sequence[int | str], filter: Filter | None = None) -> int:
        return self._of(kind).kb.remove(kind, ids, filter)

    @staticmethod
    def _entity(given: dict, previous: dict | None) -> dict:
        name = _identity(given["name"], "name")
        aliases = sorted({a.strip() for a in [name, *given.get("aliases", [])] if a.strip()})
        return {"name": name, "entity_type": given.get("entity_type", "concept"), "aliases": aliases, "attributes": dict(given.get("attributes") or {}), "summary": given.get("summary", "")}

    def _ends(self, ids: Sequence[int], given: dict) -> None:
        known = self.kb.existing("entity", ids)
        space = (given.get("namespace") or self.kb.namespace, given.get("scope") or self.kb.write_scope)
        for i in ids:
            if i not in known or (known[i]["namespace"], known[i]["scope"]) != space:
                raise ValueError(f"entity {i} is not in this namespace and scope")

    @staticmethod
    def _confidence(given: dict) -> float:
        value = float(given.get("confidence", 0.8))
        if not 0 <= value <= 1:
            raise ValueError("confidence must lie between 0 and 1")
        return value

    def _relation(self, given: dict, previous: dict | None) -> dict:
        self._ends([given["subject_id"], given["object_id"]], given)
        return {"src": given["subject_id"], "predicate": _identity(given["predicate"], "predicate"), "dst": given["object_id"], "confidence": self._confidence(given), "reason": given.get("reason", "")}

    def _event(self, given: dict, previous: dict | None) -> dict:
        people = sorted(set(given.get("participants", [])))
        self._ends(people, given)
        return {"name": _identity(given["name"], "name"), "summary": given.get("summary", ""), "participants": people, "confidence": self._confidence(given), "reason": given.get("reason", "")}

    def apply_batch(self, entities: Sequence[dict] = (), relations: Sequence[dict] = (), events: Sequence[dict] = ()) -> dict:
        """Entities, then relations, then events. Texts that name a renamed entity follow by themselves."""
        return {"entities": self.kb.put("entity", entities, self._entity), "relations": self.kb.put("relation", relations, self._relation), "events": self.kb.put("event", events, self._event)}

    def resolve(self, name: str, filter: Filter | None = None, limit: int = 10) -> list[dict]:
        rows = graph.resolve(self.kb.table("entity").where(self.kb.where(filter)), name, reads.check_limit(limit))
        return [r.asDict(recursive=True) for r in rows.collect()]

    def neighbors(self, id: int | str, filter: Filter | None = None, limit: int = 50) -> dict:
        bare = self.kb.where({**(filter or {}), "tags": []})
        rows = graph.neighbors(self.kb.table("relation").where(self.kb.where(filter)), self.kb.table("entity").where(bare), int(id), reads.check_limit(limit)).collect()
        return {"relations": [r["relation_id"] for r in rows], "entities": sorted({r["entity_id"] for r in rows})}

    def events_for_entity(self, id: int | str, filter: Filter | None = None, limit: int = 50) -> list[dict]:
        events = self.kb.table("event").where(self.kb.where(filter))
        people = events.select(F.col("id").alias("event_id"), F.explode("participants").alias("entity_id"))
        return [r.asDict(recursive=True) for r in graph.events_of(events, people, int(id), reads.check_limit(limit)).collect()]

    # Traversal.

    def edges(self, filter: Filter | None = None) -> tuple[DataFrame, DataFrame]:
        """(canonical ids, edges) with rules applied and aliases contracted."""
        rows = graph.augmented(self.kb.table("relation").where(self.kb.where(filter)), self._rules())
        return graph.contracted(rows)

    def _rules(self) -> DataFrame:
        rules = self.kb.setting("rules", {})
        return self.kb.spark.createDataFrame([(p, r.get("inverse"), bool(r.get("symmetric"))) for p, r in rules.items()], "predicate string, inverse string, symmetric boolean")

    @staticmethod
    def _canonical(canon: DataFrame, id: int) -> int:
        row = canon.where(F.col("id") == id).first()
        return row["canonical"] if row else id

    def ego_ids(self, root: int, depth: int = 1, filter: Filter | None = None, limit: int | None = None) -> list[int]:
        canon, edges = self.edges(filter)
        return [r["id"] for r in graph.ego(edges, self._canonical(canon, int(root)), depth, limit).orderBy("hop", "id").collect()]

    def ego(self, root: int, depth: int = 1, filter: Filter | None = None, limit: int = 100) -> list[dict]:
        found = self.ego_ids(root, depth, filter, reads.check_limit(limit))
        known = self.kb.existing("entity", found)
        return [known[i] for i in found if i in known]

    def path(self, start: int, end: int, filter: Filter | None = None) -> list[dict] | None:
        canon, edges = self.edges(filter)
        rows = graph.shortest_path(edges, self._canonical(canon, int(start)), self._canonical(canon, int(end))).orderBy("position").collect()
        known = self.kb.existing("entity", [r["id"] for r in rows])
        return [known[r["id"]] for r in rows if r["id"] in known] or None

    def strongly_connected(self, filter: Filter | None = None) -> list[list[int]]:
        groups: dict[int, list[int]] = {}
        for r in graph.strongly_connected(self.edges(filter)[1]).orderBy("component", "id").collect():
            groups.setdefault(r["component"], []).append(r["id"])
        return list(groups.values())

    def component_count(self, filter: Filter | None = None) -> int:
        canon, edges = self.edges(filter)
        nodes = self.kb.table("entity").where(self.kb.where(filter)).select("id").join(canon, "id", "left").select(F.coalesce("canonical", "id").alias("id")).distinct()
        return graph.component_count(nodes, edges)

    # Predicates.

    def set_predicate_rule(self, predicate: str, inverse: str | None = None, symmetric: bool = False) -> int:
        if symmetric and inverse:
            raise ValueError("a symmetric predicate has no inverse")
        return self.kb.set_setting("rules", {**self.kb.setting("rules", {}), _identity(predicate, "predicate"): {"inverse": inverse, "symmetric": symmetric}})

    def predicate_rules(self) -> dict[str, dict]:
        return self.kb.setting("rules", {})

    def delete_predicate_rule(self, predicate: str) -> bool:
        rules = self.kb.setting("rules", {})
        if predicate in rules:
            self.kb.set_setting("rules", {p: r for p, r in rules.items() if p != predicate})
        return predicate in rules

    def synonyms(self, namespace: str) -> dict[str, str]:
        return self.kb.setting(f"synonyms:{namespace}", {})

    def set_predicate_equivalents(self, namespace: str, groups: Sequence[Sequence[str]]) -> int:
        """Predicates of one group stand for each other; one that is named again moves."""
        known = dict(self.synonyms(namespace))
        for group in groups:
            known |= {p: group[0] for p in group}
        return self.kb.set_setting(f"synonyms:{namespace}", known)

    def predicate_equivalents(self, namespace: str) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for p, g in self.synonyms(namespace).items():
            groups.setdefault(g, []).append(p)
        return sorted(sorted(g) for g in groups.values())

    def delete_predicate_equivalents(self, namespace: str, predicates: Sequence[str] | None = None) -> int:
        left = {p: g for p, g in self.synonyms(namespace).items() if predicates is not None and p not in predicates}
        return self.kb.set_setting(f"synonyms:{namespace}", left or None)

    def expand_query(self, namespace: str, text: str) -> str:
        return graph.expand_query(text, self.synonyms(namespace))


class Notes(_Kind):
    kind = "note"

    def set_root(self, root: str, namespace: str | None = None) -> int:
        return self.kb.set_setting(f"root:{namespace or self.kb.namespace}", root)

    def unset_root(self, namespace: str | None = None) -> int:
        return self.kb.set_setting(f"root:{namespace or self.kb.namespace}", None)

    def root(self, namespace: str | None = None) -> str | None:
        return self.kb.setting(f"root:{namespace or self.kb.namespace}")

    def get_many(self, ids: Sequence[int], filter: Filter | None = None) -> dict[int, dict]:
        wanted = self.kb.spark.createDataFrame([(int(i),) for i in ids], "id long")
        return {r["id"]: r.asDict(recursive=True) for r in reads.load_many(self.kb.table("note"), wanted, self.kb.where(filter)).collect()}

    def chunks(self, note_id: int | str, filter: Filter | None = None) -> list[dict]:
        self.get(note_id, filter)
        return [r.asDict(recursive=True) for r in self.kb.table("chunk").where(F.col("note_id") == int(note_id)).orderBy("ordinal").collect()]

    def get_chunk(self, id: int | str, filter: Filter | None = None) -> dict:
        return self.kb.one("chunk", id, filter)

    def _path(self, path: str, namespace: str) -> str:
        root = self.root(namespace)
        if not root:
            raise ValueError("the namespace has no note root")
        base, path = root.replace("\\", "/").rstrip("/") + "/", path.replace("\\", "/")
        if not path.startswith(base) or len(path) == len(base) or "/../" in path:
            raise ValueError("a note lies below its namespace's root")
        return path[len(base) :]

    def upsert_file(self, path: str, chunk_chars: int = 220, chunk_overlap: int = 0, **given: Any) -> dict:
        """Reads a text file below the root and replaces the note of that path."""
        rows = self.kb.spark.read.text(path, wholetext=True).collect()
        content = rows[0][0] if rows else ""
        chunks = [{"content": c, "offset": o, "limit": n} for _, o, n, c in chunk_text(content, chunk_chars, chunk_overlap)]
        return self._upsert(path, chunks, {**given, "chunk_chars": chunk_chars, "chunk_overlap": chunk_overlap})

    def upsert_chunks(self, path: str, chunks: Sequence[dict], **given: Any) -> dict:
        """Replaces the note of a path by chunks that the caller made."""
        return self._upsert(path, [{"content": c["content"], "offset": c.get("offset", 1), "limit": c.get("limit") or max(1, len(c["content"].splitlines()))} for c in chunks], given)

    def _upsert(self, path: str, chunks: list[dict], given: dict) -> dict:
        namespace, scope = given.get("namespace") or self.kb.namespace, given.get("scope") or self.kb.write_scope
        relative = self._path(path, namespace)
        known = self.kb.table("note").where(self.kb.where({"namespace": namespace, "scopes": [scope]}) & (F.col("path") == relative)).first()
        if known:
            self.kb.remove("note", [known["id"]], None)
        *dirs, name = relative.split("/")
        stem = name.rsplit(".", 1)[0] if "." in name else name
        given = {**given, "namespace": namespace, "scope": scope, "tags": [*given.get("tags", []), *dirs, stem]}
        note = self.kb.put("note", [given], lambda g, _: {"path": relative, "title": stem, "chunk_chars": g.get("chunk_chars"), "chunk_overlap": g.get("chunk_overlap")})[0]
        head = {"namespace": namespace, "scope": scope, "tags": given["tags"]}
        rows = [{**head, **c, "ordinal": i} for i, c in enumerate(chunks)]
        self.kb.put("chunk", rows, lambda g, _: {"note_id": note["id"], "ordinal": g["ordinal"], "offset": g["offset"], "limit": g["limit"], "content": g["content"]})
        return {**note, "chunks": len(rows)}


class Embeddings(_Part):
    def register_space(self, id: str, model: str, dimension: int, encoding: str = "sq8", text_version: int = 1) -> int:
        if not 1 <= dimension <= 65_536 or encoding not in ("f32", "sq8") or text_version != 1:
            raise ValueError("a space has 1 to 65536 dimensions, is f32 or sq8, and its text version is 1")
        spaces, space = self.kb.setting("spaces", {}), {"model": model, "dimension": dimension, "encoding": encoding, "text_version": text_version}
        if spaces.get(_identity(id, "space"), space) != space:
            raise Conflict("a space does not change")
        return self.kb.set_setting("spaces", {**spaces, id: space})

    def spaces(self) -> dict[str, dict]:
        return self.kb.setting("spaces", {})

    def embedder_space(self) -> str | None:
        return self.kb._embedder[0] if self.kb._embedder else None

    def unregister_embedder(self) -> None:
        self.kb._embedder = None

    def delete_space(self, id: str) -> int:
        left = {k: v for k, v in self.spaces().items() if k != id}
        self.kb.tables.commit({"vector": self.kb.table("vector").where(F.col("space") != id)})
        return self.kb.set_setting("spaces", left)

    def namespace_vectorization(self, namespace: str) -> bool:
        return self.kb.setting(f"vectorize:{namespace}", False)

    def set_namespace_vectorization(self, namespace: str, on: bool) -> int:
        return self.kb.set_setting(f"vectorize:{namespace}", bool(on))

    def vectorization(self, namespace: str) -> dict[str, bool]:
        return {t: self.kb.setting(f"vectorize:{namespace}:{t}", t != "notes") for t in TARGETS}

    def set_vectorization(self, namespace: str, target: str, on: bool) -> int:
        if target not in TARGETS:
            raise ValueError(f"no target {target}")
        return self.kb.set_setting(f"vectorize:{namespace}:{target}", bool(on))

    def _enabled(self, namespace: str | None = None) -> DataFrame:
        """Texts that should have a vector."""
        texts, keep = self.kb.texts(), F.lit(False)
        names = [namespace] if namespace else [k.split(":")[1] for k in self.kb.tables.manifest["settings"] if k.startswith("vectorize:") and k.count(":") == 1]
        for name in names:
            if self.namespace_vectorization(name):
                kinds = [k for t, on in self.vectorization(name).items() if on for k in TARGETS[t]]
                keep |= (F.col("namespace") == name) & F.col("kind").isin(kinds)
        return texts.where(keep)

    def ready(self, space: str, namespace: str | None = None) -> bool:
        enabled = self._enabled(namespace)
        return self.namespace_vectorization(namespace or self.kb.namespace) and vectorsearch.is_ready(enabled, self.kb.table("vector").where(F.col("space") == space))

    vector_ready = ready

    def decoded(self, space: str) -> DataFrame:
        """Vectors of a space as floats."""
        from mnemolake.functions.vectors import sq8_decode

        rows = self.kb.table("vector").where(F.col("space") == space)
        return rows.withColumn("vector", F.coalesce("vector", sq8_decode("codes", "scale")))

    def sync(self, namespace: str | None = None) -> dict:
        """Drops orphans and fills gaps of the registered embedder's space."""
        if not self.kb._embedder:
            raise ValueError("register an embedder first")
        space, model, batch, budget = self.kb._embedder
        rows, enabled = self.kb.table("vector"), self._enabled(namespace)
        mine, others = rows.where(F.col("space") == space), rows.where(F.col("space") != space)
        kept = mine.join(self.kb.texts().select("id"), "id", "left_semi").select(*rows.columns)
        gaps = enabled.join(kept.select("id"), "id", "left_anti")
        filled = embedding.fill_gaps(gaps.select("id", F.col("embed").alias("text")), model, batch, budget)
        new = filled.join(gaps.select("id", "namespace", "scope", "kind", "tags", "note_id"), "id")
        if self.spaces()[space]["encoding"] == "sq8":
            new = vectorsearch.quantize(new).withColumn("vector", F.lit(None).cast("array<float>"))
        else:
            new = new.withColumn("scale", F.lit(None).cast("float")).withColumn("codes", F.lit(None).cast("array<tinyint>"))
        before, stay, missing = mine.count(), kept.count(), gaps.count()
        self.kb.tables.commit({"vector": others.unionByName(kept).unionByName(new.withColumn("space", F.lit(space)).select(*rows.columns))})
        return {"deleted": before - stay, "filled": missing, "ready": self.ready(space, namespace or self.kb.namespace)}
