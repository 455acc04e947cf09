"""Deep reading: notes from chunks through a text-generation client, then summary, findings, limitations and terms.

A client is any picklable object with ``chat(prompt, system, as_json) -> str``; what it raises becomes an error text of
the row. Calls are made in Arrow batches on executors. Each stage is a table of its own, so a stage that is switched
off is not part of the plan.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..session import written as kept
from . import answers, chunk

#: Keys of the summary and what they ask for.
SUMMARY = ("objetivo", "metodologia", "resultados", "conclusao", "relevancia")
MISSING = "nao informado"
FINDINGS, LIMITATIONS, TERMS, SNIPPETS = 6, 6, 10, 8
CONTEXT, LIMITATION_CONTEXT, TERM_CONTEXT, EXCERPT = 14_000, 11_000, 9_000, 2_500
STAGES = ("summary", "findings", "limitations", "terms", "syntheses")
SYSTEM = "You read scientific articles critically. Answer in Brazilian Portuguese, briefly, from the given text alone; where it says nothing, answer 'nao informado'. Never invent figures, authors or quotations."


class Client(Protocol):
    def chat(self, prompt: str, system: str, as_json: bool) -> str: ...


@dataclass(frozen=True)
class HttpClient:
    """Client of a model server with a chat route that answers in JSON, whole or in lines."""

    url: str = "http://localhost:11434"
    model: str = "gemma3:4b"
    context: int = 6144
    temperature: float = 0.2
    timeout: int = 600

    def payload(self, prompt: str, system: str | None, as_json: bool) -> dict:
        messages = [{"role": "system", "content": system}] if system else []
        body = {"model": self.model, "messages": [*messages, {"role": "user", "content": prompt}], "options": {"temperature": self.temperature, "num_ctx": self.context}}
        return body | ({"format": "json"} if as_json else {})

    def _open(self, path: str, body: dict | None = None, timeout: float | None = None):
        data = json.dumps(body).encode() if body is not None else None
        return urllib.request.urlopen(urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"}), timeout=timeout or self.timeout)  # noqa: S310

    def chat(self, prompt: str, system: str, as_json: bool) -> str:
        with self._open("/api/chat", self.payload(prompt, system, as_json) | {"stream": True}) as answer:
            return joined_stream(answer)

    def models(self) -> list[str]:
        with self._open("/api/tags", timeout=10) as answer:
            return sorted(m["name"] for m in json.load(answer).get("models", []) if m.get("name"))

    def diagnosis(self) -> tuple[bool, str]:
        try:
            names = self.models()
        except (urllib.error.URLError, OSError, ValueError) as e:
            return False, f"no answer from {self.url}: {e}"
        if not model_installed(self.model, names):
            return False, f"model {self.model} is not installed"
        return True, f"{self.url} is ready with {self.model}"


def model_installed(model: str, names: list[str]) -> bool:
    """A bare name also means its latest version."""
    return model in names or (":" not in model and f"{model}:latest" in names)


def joined_stream(lines) -> str:
    """The text of a streamed answer: lines that are no JSON are skipped, an error raises, and it ends at done."""
    parts = []
    for line in lines:
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if event.get("error"):
            raise RuntimeError(event["error"])
        parts.append((event.get("message") or {}).get("content", ""))
        if event.get("done"):
            break
    return "".join(parts)


def _ask(client: Client, as_json: bool):
    def answered(prompt: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if prompt is None else client.chat(prompt, SYSTEM, as_json)), None
        except Exception as e:  # noqa: BLE001  a client's failure is a result
            return None, str(e)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            replies = [answered(p) for p in batch.column(batch.schema.get_field_index("prompt")).to_pylist()]
            columns = [pa.array([r[i] for r in replies], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "answer", "error"])

    return run


def ask(rows: DataFrame, client: Client, as_json: bool = False, prompts: bool = True) -> DataFrame:
    """Adds answer and error for rows with a prompt, which stays only with ``prompts``.

    A step of its own in the plan: as an expression, Spark would ask once for a filter and again for the result. Of a
    client whose answers are ``answers.Stored``, only what is missing is asked for.
    """
    if isinstance(client, answers.Stored):
        return answers.ask(rows, client, SYSTEM, as_json, prompts)
    schema = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])
    out = rows.mapInArrow(_ask(client, as_json), schema)
    return out if prompts else out.drop("prompt")


def lenient_json(c: Column) -> Column:
    """JSON in an answer as a variant: the whole, else from its first to its last brace, else bracket; else null."""
    bare = T.strip(c)
    bare = F.when(bare.startswith("```"), T.strip(F.regexp_replace(F.regexp_replace(bare, "^`+|`+$", ""), "^(?i)json", ""))).otherwise(bare)
    braces, brackets = (F.regexp_extract(bare, p, 0) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]"))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(braces, F.lit(""))), F.try_parse_json(F.nullif(brackets, F.lit(""))))


def note_prompts(docs: DataFrame, size: int = chunk.MODEL_SIZE, overlap: int = chunk.OVERLAP, most: int = chunk.MODEL_CHUNKS) -> DataFrame:
    """(doc_id, index, label, prompt) for the first chunks of each document."""
    rows = chunk.chunks(docs, size, overlap).filter(F.col("index") < most)
    text = F.concat(F.lit("Part of the article ("), "label", F.lit("):\n\n"), "text", F.lit("\n\nList at most 5 facts of this part (aim, method, data, figures, results, limitations), one per line, as '- ["), "label", F.lit("] fact'. Nothing else."))
    return rows.select("doc_id", "index", "label", text.alias("prompt"))


def notes(docs: DataFrame, client: Client, **options) -> DataFrame:
    """(doc_id, index, note): answers for chunks; a failed call leaves a placeholder, an empty answer nothing."""
    rows = ask(note_prompts(docs, **options), client, prompts=False)
    note = F.when(F.col("error").isNotNull(), F.concat(F.lit("- ["), "label", F.lit("] (falha ao ler este bloco: "), "error", F.lit(")"))).otherwise(T.strip(F.col("answer")))
    return rows.select("doc_id", "index", note.alias("note")).filter("note <> ''")


def _part(name: str) -> Column:
    """The beginning of a section, null if there is none."""
    return F.nullif(T.section_text(F.col("text"), F.col("sections"), name, EXCERPT), F.lit(""))


def contexts(docs: DataFrame, noted: DataFrame, limit: int = CONTEXT) -> DataFrame:
    """(doc_id, context, extra): notes in order and excerpts of abstract and conclusion, cut to the limit.

    ``extra`` is the beginning of the section on limitations, or else of the discussion. Whole texts are not shuffled.
    """
    listed = noted.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("index", "note")))["note"], "\n").alias("body"))
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"### Secao {name}\n"), _part(name)) for name in ("resumo", "conclusao"))))
    rows = docs.select("doc_id", parts.alias("parts"), F.coalesce(_part("limitacoes"), _part("discussao")).alias("extra")).join(listed, "doc_id", "left")
    whole = F.concat_ws("\n\n", F.concat(F.lit("### Notas de leitura\n"), F.coalesce("body", F.lit(""))), "parts")
    return rows.select("doc_id", F.left(whole, F.lit(limit)).alias("context"), "extra")


def _asked(context: DataFrame, client: Client, request: str) -> DataFrame:
    rows = context.select("doc_id", F.concat("context", F.lit("\n\n" + request)).alias("prompt"))
    return ask(rows, client, True, prompts=False).withColumn("json", lenient_json(F.col("answer")))


def _texts(json: Column, key: str, most: int) -> Column:
    """A list of texts under a key, or as the whole answer; blank ones go."""
    items = F.coalesce(F.try_variant_get(json, f"$.{key}", "array<string>"), F.try_variant_get(json, "$", "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(items, lambda i: T.strip(F.coalesce(i, F.lit("")))), lambda i: i != ""), 1, most)


def summaries(context: DataFrame, client: Client) -> DataFrame:
    """(doc_id, summary struct, error): missing keys say so; an answer that is no object is an error."""
    rows = _asked(context, client, "Return a JSON object with the keys " + ", ".join(SUMMARY) + f"; each at most 3 short sentences, or '{MISSING}'.")
    value = lambda k: F.coalesce(T.strip(F.try_variant_get("json", f"$.{k}", "string")), F.lit(MISSING)).alias(k)
    is_object = F.coalesce(F.schema_of_variant("json").startswith("OBJECT"), F.lit(False))
    return rows.select("doc_id", F.when(is_object, F.struct(*map(value, SUMMARY))).alias("summary"), F.when(~is_object, F.coalesce("error", F.lit("the summary has an unexpected form"))).alias("error"))


def parsed_findings(json: Column, most: int = FINDINGS) -> Column:
    """Findings with a claim, as array<struct<claim,evidence,page>>; bare texts are claims."""
    items = F.coalesce(F.try_variant_get(json, "$.achados", "array<variant>"), F.try_variant_get(json, "$", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda v, k: T.strip(F.coalesce(F.try_variant_get(v, k, "string"), F.lit("")))
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    made = F.transform(items, lambda v: F.struct(F.when(is_text(v), text(v, "$")).otherwise(text(v, "$.afirmacao")).alias("claim"), F.when(is_text(v), "").otherwise(text(v, "$.evidencia")).alias("evidence"), F.when(is_text(v), "").otherwise(T.page_label(text(v, "$.pagina"))).alias("page")))
    return F.slice(F.filter(made, lambda f: f["claim"] != ""), 1, most)


def findings(context: DataFrame, client: Client, most: int = FINDINGS) -> DataFrame:
    rows = _asked(context, client, f'List at most {most} central findings as JSON {{"achados": [{{"afirmacao": "...", "evidencia": "...", "pagina": "..."}}]}}; the page as in the notes, or empty.')
    return rows.select("doc_id", parsed_findings(F.col("json"), most).alias("findings"), "error")


def limitations(context: DataFrame, client: Client, most: int = LIMITATIONS) -> DataFrame:
    """(doc_id, limitations, error) from ``contexts``: what is asked also has the section on limitations, or else the discussion."""
    extra = F.when(F.col("extra").isNotNull(), F.concat(F.lit("### Trecho de discussao/limitacoes\n"), "extra"))
    rows = context.withColumn("context", F.concat_ws("\n\n", F.left("context", F.lit(LIMITATION_CONTEXT)), extra))
    rows = _asked(rows, client, f'List at most {most} limitations or gaps as JSON {{"limitacoes": ["..."]}}; open questions begin with "Lacuna: ".')
    return rows.select("doc_id", _texts(F.col("json"), "limitacoes", most).alias("limitations"), "error")


def suggested_terms(context: DataFrame, client: Client, most: int = TERMS) -> DataFrame:
    rows = _asked(context.withColumn("context", F.left("context", F.lit(TERM_CONTEXT))), client, f'List at most {most} key terms as JSON {{"keywords": ["..."]}}.')
    return rows.select("doc_id", _texts(F.col("json"), "keywords", most).alias("terms"), "error")


def syntheses(scanned: DataFrame, client: Client | None) -> DataFrame:
    """Adds synthesis to scan results: only for keywords that were found the client is asked; without one, a fixed text."""
    absent = F.concat(F.lit('O termo "'), "keyword", F.lit('" nao aparece literalmente no texto extraido do artigo. Verifique sinonimos ou variacoes.'))
    missing = scanned.filter("not found").withColumn("synthesis", absent)
    if client is None:
        return missing.unionByName(scanned.filter("found").withColumn("synthesis", F.lit("(sintese desativada)")))
    lines = F.transform(F.slice("occurrences", 1, SNIPPETS), lambda o: F.concat(F.lit("- (p. "), o["page"], F.coalesce(F.concat(F.lit(", secao "), o["section"]), F.lit("")), F.lit(") "), o["snippet"]))
    prompt = F.concat(F.lit('Passages with the term "'), "keyword", F.lit('":\n\n'), F.array_join(lines, "\n"), F.lit("\n\nIn at most 5 sentences: what does the article say about it? Give pages in brackets."))
    rows = ask(scanned.filter("found").withColumn("prompt", prompt), client, prompts=False)
    text = F.when(F.col("error").isNotNull(), F.concat(F.lit("(falha ao sintetizar: "), "error", F.lit(")"))).otherwise(T.strip(F.col("answer")))
    return missing.unionByName(rows.withColumn("synthesis", text).drop("answer", "error"))


def analyse(docs: DataFrame, scanned: DataFrame, client: Client, stages: tuple[str, ...] = STAGES, **options) -> DataFrame:
    """One nested row per document with what the chosen stages give, and an array of their errors.

    Notes are taken once, if any stage is on, and kept for all.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    # Written, not cached: a lost executor must not ask the client again and give some stages other answers. Documents,
    # contexts and scan results are written, too, as each is read by several stages and twice by each asking.
    places = F.transform("pages", lambda p: F.struct(p["number"].alias("number"), p["start"].alias("start"), p["end"].alias("end")))
    docs = kept(docs.select("doc_id", "text", "sections", places.alias("pages")), "docs") if set(stages) else docs
    noted = kept(notes(docs, client, **options), "notes") if set(stages) else None
    context = kept(contexts(docs, noted), "contexts") if noted is not None else None
    made = {
        "summary": lambda: summaries(context, client), "findings": lambda: findings(context, client),
        "limitations": lambda: limitations(context, client), "terms": lambda: suggested_terms(context, client),
    }
    rows, errors = docs.select("doc_id"), []
    for name in (s for s in STAGES if s in stages and s in made):
        rows = rows.join(made[name]().withColumnRenamed("error", f"error_{name}"), "doc_id", "left")
        errors.append(F.when(F.col(f"error_{name}").isNotNull(), F.concat(F.lit(f"{name}: "), f"error_{name}")))
    rows = rows.withColumn("errors", F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")).drop(*(f"error_{n}" for n in made))
    scanned = kept(scanned, "scanned") if "syntheses" in stages else scanned
    written = syntheses(scanned, client if "syntheses" in stages else None)
    listed = written.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "keyword", "total", "pages", "density", "synthesis"))).alias("keywords"))
    return rows.join(listed, "doc_id", "left")


NOTES_SHARE = 0.45
#: What options may be, and the sizes of a context to choose from.
TEMPERATURE, CHUNK_SIZE, CHUNK_COUNT = (0.0, 1.0), (2000, 12_000), (4, 60)
CONTEXT_SIZES = (2048, 4096, 6144, 8192, 16_384, 32_768)


def bad_options(temperature: Column, chunk_size: Column, chunk_count: Column, context: Column) -> Column:
    """Names of options that are out of their ranges; a null option takes its default, so it is none of them."""
    tests = {"temperature": ~temperature.between(*TEMPERATURE), "chunk_size": ~chunk_size.between(*CHUNK_SIZE), "chunk_count": ~chunk_count.between(*CHUNK_COUNT), "context": ~context.isin(*CONTEXT_SIZES)}
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in tests.items())))


def progress(stage: str, done: float) -> float:
    """Share of the work done: notes take the first 45 %, the other stages the rest."""
    return NOTES_SHARE * done if stage == "notes" else NOTES_SHARE + (1 - NOTES_SHARE) * done


def shares(stages: tuple[str, ...] = STAGES, n_keywords: int = 0) -> list[tuple[str, float]]:
    """(stage, share done as it begins), in order; a synthesis of each keyword has the share once it is asked for."""
    active = [s for s in STAGES[:-1] if s in stages]
    n = n_keywords if "syntheses" in stages else 0
    total = max(1, len(active) + (n > 0))
    steps = [(s, at / total) for at, s in enumerate(active)] + [(f"synthesis {i}/{n}", (len(active) + i / n) / total) for i in range(1, n + 1)]
    return [(s, round(progress(s, done), 4)) for s, done in steps]


def events(items: DataFrame, outcomes: DataFrame, stages: tuple[str, ...] = STAGES, n_keywords: int = 0) -> DataFrame:
    """(session_id, position, step, kind, doc_id, name, total, stage, share, message): what is told of a deep reading, in order.

    ``items`` has (session_id, position, doc_id, name), positions from 1; ``outcomes`` (session_id, doc_id, error). An item
    begins, passes its stages and ends; one with an error ends with it instead, one without an outcome is still at work.
    A session begins before its first item (position 0) and ends after its last one, with the number of items read and
    the names of those that failed, once none is at work; a session without items only ends.
    """
    text, none = (lambda c: F.lit(c).cast("string")), F.lit(None)
    done = outcomes.groupBy("session_id", "doc_id").agg(F.min("error").alias("error"), F.lit(True).alias("over"))
    sizes = items.groupBy("session_id").agg(F.count("*").cast("int").alias("total"), F.max("position").alias("last"))
    rows = items.join(done, ["session_id", "doc_id"], "left").join(sizes, "session_id")
    row = lambda step, kind, stage=None, share=None, message=none: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text(stage).alias("stage"), F.lit(share).cast("double").alias("share"), message.cast("string").alias("message"))
    told = shares(stages, n_keywords)
    over, failed = F.coalesce("over", F.lit(False)), F.col("error").isNotNull()
    own = [row(0, "artigo_inicio"), *(F.when(over & ~failed, row(i, "progresso", s, share)) for i, (s, share) in enumerate(told, 1)), F.when(over & failed, row(len(told) + 1, "artigo_erro", message=F.col("error"))).when(over, row(len(told) + 1, "artigo_fim"))]
    each = rows.select("session_id", "position", "doc_id", "name", "total", F.explode(F.array_compact(F.array(*own))).alias("of"))
    each = each.select("session_id", "position", "of.step", "of.kind", "doc_id", "name", "total", "of.stage", "of.share", "of.message")
    whole = rows.groupBy("session_id").agg(F.first("total").alias("total"), F.first("last").alias("last"), F.count_if(over).alias("over"), F.count_if(over & ~failed).alias("read"), F.array_sort(F.collect_list(F.when(over & failed, F.struct("position", "name")))).alias("failed"))
    ends = F.array_compact(F.array(
        F.struct(F.lit(0).alias("position"), F.lit("inicio").alias("kind"), none.cast("string").alias("message")),
        F.when(F.col("over") == F.col("total"), F.struct((F.col("last") + 1).cast("int").alias("position"), F.lit("fim").alias("kind"), F.concat_ws("; ", F.col("read").cast("string"), F.array_join("failed.name", ", ")).alias("message"))),
    ))
    whole = whole.select("session_id", "total", F.explode(ends).alias("of"))
    return each.unionByName(whole.select("session_id", "of.position", F.lit(0).alias("step"), "of.kind", "total", "of.message"), allowMissingColumns=True)


def merged_keywords(scanned: DataFrame, synthesised: DataFrame) -> DataFrame:
    """What a scan found, with the syntheses of an analysis by keyword; of documents without a scan, the analysis' own.

    Both have (doc_id, position, keyword, total, pages, density), ``synthesised`` also synthesis. A null id has no synthesis.
    """
    shared = ["doc_id", "position", "keyword", "total", "pages", "density"]
    by = ["doc_id", "keyword"]
    found = scanned.select(*shared).join(synthesised.groupBy(*by).agg(F.min("synthesis").alias("synthesis")), by, "left")
    rest = synthesised.join(scanned.select("doc_id").distinct(), "doc_id", "left_anti").select(*shared, "synthesis")
    return found.unionByName(rest).select(*shared, F.coalesce("synthesis", F.lit("")).alias("synthesis"))


_LABEL = re.compile(r"^lacuna:", re.IGNORECASE)


def is_open_question(c: Column) -> Column:
    return c.rlike(f"(?iU){_LABEL.pattern}")
