"""Answering a question from the tables: tools that route, search, read records and compare peers, and the chain of them.

Every tool is a query over DataFrames whose few rows come to the driver. Language models are an interface: without one, or
if it fails, the answer sums up what the tools found.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.text import assessment, item_list, keywords, truncated, with_assessment
from orelode.operators import estimates, peers, retrieval, routing
from orelode.sources.files import document

MOST_CONTEXT, MOST_PAIRS, MOST_FLAGS, MOST_PEERS, PLAYBOOK_SHOWN = 14_000, 10, 12, 12, 2000
CUT = "\n… [truncated]"
DEFAULT_ITEMS = [1, 25]
# Parts of a question that ask for a comparison with peers.
PEER_PARTS = ["benchmark", "comparable", "peer", "reasonable compared", "typical range", "normal range", "vs peer", "against peer", "similar project"]


class Embedder(Protocol):
    def __call__(self, text: str) -> list[float]: ...


class Answerer(Protocol):
    def __call__(self, prompt: str) -> str: ...


@dataclass
class Corpus:
    """The tables that answers come from; see the operators for their columns. `documents` are whole records with their stem."""

    chunks: DataFrame
    rules: DataFrame
    items: DataFrame
    matrices: DataFrame
    reports: DataFrame
    stop: list[str] = field(default_factory=list)
    documents: DataFrame | None = None
    templates: DataFrame | None = None


@dataclass
class Answer:
    primary: list[int]
    cross: list[int]
    playbook: str
    context: str
    sources: list[tuple]
    peers: list[str]
    text: str
    flags: list[str] = field(default_factory=list)
    assessment: str | None = None
    peer_text: str = ""
    tools: list[str] = field(default_factory=list)
    template: str | None = None


def told(history: list[tuple[str, str]], most: int = MOST_PAIRS) -> str:
    """The last pairs of a dialog, or "None"."""
    return "\n\n".join(f"User: {q}\nAssistant: {a}" for q, a in list(history)[-most:]) or "None"


class Tools:
    """The tools of one question, and what they have found so far. `scope` are the files that it is about, if any."""

    def __init__(self, spark: SparkSession, corpus: Corpus, question: str, embed: Embedder, scope: list[str] = (), history: list[tuple[str, str]] = (), k: int = 10):
        self.spark, self.corpus, self.question, self.embed = spark, corpus, question, embed
        self.scope, self.history, self.k = list(scope), list(history), max(k, 1)
        self.primary: list[int] = []
        self.cross: list[int] = []
        self.template: str | None = None
        self.text_of_playbook, self.peer_text = "", ""
        self.blocks: list[str] = []
        self.sources: list[tuple] = []
        self.peers: list[str] = []
        self.flags: list[str] = []
        self.calls: list[str] = []

    def _one(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "id int, text string")

    def _target(self) -> str | None:
        return self.scope[0] if len(self.scope) == 1 else None

    def _route(self, text: str):
        q = self._one(text)
        rows = routing.with_topics(routing.routed(q, self.corpus.rules), q).withColumn("peers", routing.wants_peers(F.lit(text), PEER_PARTS))
        if self.corpus.templates is not None:
            rows = rows.join(routing.first_template(q, self.corpus.templates), "id")
        return rows.first()

    def route(self) -> dict:
        """Items and template of the question with its history before it."""
        self.calls.append("route_question")
        r = self._route("\n\n".join([*([told(self.history)] if self.history else []), self.question]))
        self.primary, self.cross = list(r.primary_items), list(r.cross_items)
        self.template = r.template if "template" in r else None
        return {"primary_items": self.primary, "cross_check_items": self.cross, "matched_patterns": list(r.matched), "benchmark_template": self.template, "needs_peer_benchmark": bool(r.peers or self.template)}

    def _items(self, text: str, default: list[int]) -> list[int]:
        found = self._one(text).select(item_list(F.col("text")).alias("x")).first().x
        return found or default or DEFAULT_ITEMS

    def playbook(self, items: str = "") -> str:
        """The playbook of the given items, or of all routed ones."""
        self.calls.append("get_routing_playbook")
        numbers = self._items(items, self.primary + self.cross)
        wanted = self.spark.createDataFrame([(0, i, n) for i, n in enumerate(numbers)], "id int, pos int, item int")
        self.text_of_playbook = routing.playbooks(wanted, self.corpus.items, self.corpus.matrices).first().playbook
        return self.text_of_playbook or "No playbook found for these items."

    def search(self, items: str = "", query: str = "") -> dict:
        """The best chunks of some items, or of all where those have none, in the scope."""
        self.calls.append("search_by_items")
        numbers = self._items(items, self.primary)
        asked = query.strip() or self.question
        queries = self.spark.createDataFrame([(0, [float(x) for x in self.embed(asked)])], "query_id int, query array<float>")
        words = keywords(F.lit(asked), self.corpus.stop)
        rows: list = []
        for chosen in (numbers, None):
            clause = retrieval.metadata_filter(sources=self.scope, items=chosen)
            own = self.corpus.chunks if clause is None else self.corpus.chunks.where(clause)
            best = retrieval.reranked(retrieval.nearest(own, queries, retrieval.over_fetch(self.k, 2**31)), words, self.k)
            rows = best.select("rank", "source", "page", "id").orderBy("rank").collect()
            if rows:
                break
        context = retrieval.context(best).select(truncated(F.col("context"), MOST_CONTEXT, CUT).alias("c")).first().c if rows else ""
        self.sources += [(r.source, r.page, r.id) for r in rows]
        if context:
            self.blocks.append(f"### Retrieved: Items {numbers}" + (f" ({self.scope[0]})" if self.scope else "") + f"\n{context}")
        return {"items_searched": numbers, "context": context or "No matching chunks found.", "source_count": len(rows)}

    def record(self, filename: str = "") -> str:
        """The record of a file, or of the one in scope, as JSON without what is empty."""
        self.calls.append("get_extraction")
        name = filename.strip() or self._target() or ""
        if not name or self.corpus.documents is None:
            return json.dumps({"error": "No report given."})
        row = estimates.slim(document(self.corpus.documents, name)).select(truncated(F.col("document"), MOST_CONTEXT, CUT).alias("d")).first()
        if row is None:
            return json.dumps({"error": f"No record of {name}."})
        self.blocks.append(f"### Structured extraction: {name}\n{row.d}")
        return row.d

    def find_peers(self, limit: int = 8, **filters: str) -> dict:
        """Peers of the report in scope, by filters (fields of POINTS), each that isn't given from the report itself."""
        self.calls.append("find_peer_reports")
        target = self._target()
        wanted = {k: v.strip() for k, v in filters.items() if v and v.strip()}
        own = self.corpus.reports.where(F.lower("source_file") == target.lower()).first() if target else None
        if own:
            wanted = {f: own[f] for f in peers.POINTS if own[f]} | wanted
        found = peers.peers(self.corpus.reports, target, wanted, min(max(limit, 1), MOST_PEERS)).orderBy("place")
        rows = found.join(self.corpus.reports, "source_file").orderBy("place").collect()
        self.peers = [r.source_file for r in rows]
        lines = [f"{r.source_file}: {r.country or '?'}, commodity={r.commodity or '?'}, stage={r.study_stage or '?'}" for r in rows]
        self.peer_text = "\n".join(lines) or "No peer reports matched."
        return {"peer_count": len(rows), "peers": lines, "source_files": self.peers}

    def benchmark(self, name: str = "", files: str = "") -> dict:
        """A numeric field of the report in scope against given files, or its best peers without filters."""
        self.calls.append("benchmark_field")
        asked = name.strip() or self._one(self.question).select(peers.inferred_field(F.col("text")).alias("x")).first().x or "cutoff_grade"
        target = self._target()
        chosen = [f.strip() for f in files.split(",") if f.strip()] or [r.source_file for r in peers.peers(self.corpus.reports, target).collect()]
        if self.corpus.documents is None:
            return {"field": asked, "count": 0, "entries": [], "outliers": []}
        own = F.lower("source_file") == (target or "").lower()
        values = estimates.values(self.corpus.documents.where(F.col("source_file").isin(chosen) | own), asked)
        values = values.withColumn("is_target", F.coalesce(own, F.lit(False))).persist()
        summary, text = peers.benchmark(values).first(), peers.range_texts(values).first()
        listed = peers.entries(values).orderBy("pos").collect()
        told_entries = estimates.summaries(peers.entries(values)).first()
        values.unpersist()
        if summary is None:
            return {"field": asked, "count": 0, "summary": f"No '{asked}' values found.", "entries": [], "outliers": []}
        outside = [f"Target value {e.value:g} is outside the peers' range [{summary.low:.4g}, {summary.high:.4g}]" for e in listed if e.is_target and summary.low is not None and _outside(e.value, summary.low, summary.high)]
        self.flags += outside
        line = f"{text.text} {told_entries.summary}"
        self.peer_text = f"{self.peer_text}\n{line}" if self.peer_text else line
        return {"field": asked, "count": summary["count"], "min": summary.low, "max": summary.high, "median": summary["median"], "summary": line, "entries": [(e.source_file, e.value, e.unit) for e in listed], "outliers": outside}

    def all(self) -> dict:
        """The tools by the names that a model calls them by."""
        return {"route_question": self.route, "search_by_items": self.search, "get_extraction": self.record, "find_peer_reports": self.find_peers, "benchmark_field": self.benchmark, "get_routing_playbook": self.playbook}

    def chain(self) -> Tools:
        """All tools in turn: route, playbook, search of primary and of cross items, record, and peers where they are asked for."""
        self.route()
        self.playbook(",".join(map(str, self.primary)))
        self.search(",".join(map(str, self.primary)))
        if self.cross:
            self.search(",".join(map(str, self.cross)))
        if self._target():
            self.record()
        asked = self._route(self.question)
        if asked.peers or ("template" in asked and asked.template):
            self.find_peers()
            self.benchmark()
        return self

    def prompt(self) -> str:
        """What a model is asked after the chain."""
        parts = [f"Conversation history:\n{told(self.history)}"] if self.history else []
        parts.append(f"Current question: {self.question}")
        if self.scope:
            parts.append(f"Report scope: {', '.join(self.scope)}")
        found = [*self.blocks, *([f"### Due diligence playbook\n{self.text_of_playbook}"] if self.text_of_playbook else []), *([f"### Peer benchmark\n{self.peer_text}"] if self.peer_text else [])]
        parts.append("Retrieved context:\n" + "\n\n".join(found) if found else "No retrieved context was found.")
        return "\n\n".join(parts)

    def summary(self, why: str | None = None) -> str:
        """An answer without a model: what the tools found."""
        lines = [f"Model failed: {why}"] if why else []
        lines += [f"Routed items: {self.primary}", f"Cross-check items: {self.cross}", f"Tools called: {' -> '.join(self.calls)}"]
        if self.peer_text:
            lines.append(f"Peer benchmark:\n{self.peer_text}")
        if self.text_of_playbook:
            lines.append(f"Playbook:\n{self.text_of_playbook[:PLAYBOOK_SHOWN]}" + ("\n…" if len(self.text_of_playbook) > PLAYBOOK_SHOWN else ""))
        lines.append(f"Sources: {len(self.sources)}")
        return "\n".join(lines)

    def result(self, answer: str) -> Answer:
        """The answer with its flags and, where the question asks for one, an assessment."""
        flag_lines = ";".join(x.removeprefix("Flag:") for x in self.text_of_playbook.splitlines() if x.startswith("Flag:"))
        row = self._one(answer).select(routing.playbook_flags(F.lit(flag_lines), F.col("text")).alias("f"), "text")
        flags = [*row.first().f, *self.flags]
        found = assessment(F.lit(self.question), F.col("text"), F.lit(len(flags)))
        done = row.select(found.alias("a"), with_assessment(F.col("text"), found).alias("t")).first()
        seen = list(dict.fromkeys(self.sources))
        return Answer(self.primary, self.cross, self.text_of_playbook, "\n\n".join(self.blocks), [(s, p) for s, p, _ in seen], self.peers, done.t, flags[:MOST_FLAGS], done.a, self.peer_text, self.calls, self.template)


def _outside(value: float, low: float, high: float) -> bool:
    spread = high - low
    return value < low - 0.25 * spread or value > high + 0.25 * spread if spread > 0 else value != low


def ask(spark: SparkSession, corpus: Corpus, question: str, vector: list[float] | Embedder, k: int = 10, target: str | None = None, model: Answerer | None = None, history: list[tuple[str, str]] = ()) -> Answer:
    """Run the chain of tools and answer by the model, or by a summary of what was found without one or if it fails.

    `vector` is the question's vector, or what makes vectors of texts; `target` the report in scope.
    """
    embed = vector if callable(vector) else lambda _: vector
    tools = Tools(spark, corpus, question, embed, [target] if target else [], history, k).chain()
    text, why = None, None
    if model is not None:
        try:
            text = model(tools.prompt())
        except Exception as error:  # the summary stands in
            why = str(error)
    return tools.result(text if text is not None else tools.summary(why))


def stream(spark: SparkSession, corpus: Corpus, question: str, vector: list[float] | Embedder, tokens, target: str | None = None, history: list[tuple[str, str]] = (), k: int = 10) -> Iterator[dict]:
    """Events of an answer in order: two of status, one of meta, one for each token, and done; an error only if no token came.

    `tokens` gives the parts of a model's answer to a prompt, one by one.
    """
    yield {"type": "status", "message": "Running tools"}
    embed = vector if callable(vector) else lambda _: vector
    tools = Tools(spark, corpus, question, embed, [target] if target else [], history, k).chain()
    yield {"type": "status", "message": "Writing the answer"}
    yield {"type": "meta", "routed_items": tools.primary, "cross_check_items": tools.cross, "tool_calls": tools.calls, "peer_summary": tools.peer_text}
    parts: list[str] = []
    try:
        for part in tokens(tools.prompt()):
            parts.append(part)
            yield {"type": "token", "content": part}
    except Exception as error:  # what has come so far is the answer
        if not parts:
            yield {"type": "error", "message": str(error)}
            return
    done = tools.result("".join(parts))
    yield {"type": "done", "answer": done.text, "sources": done.sources, "flags": done.flags, "assessment": done.assessment}
