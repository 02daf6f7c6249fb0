"""The built-in workflows. Features and least lengths come from functions.features by kind."""

from __future__ import annotations

from dataclasses import replace

from corpusmill.functions import features as ft
from corpusmill.functions.text import MIME
from corpusmill.plans.workflow import Step, Workflow

#: Fixed values below: ids, names and order of steps, model versions, weights, tags, sizes.
UNSEEN = "content_hash NOT IN (SELECT hash FROM corpus.chunks)"
SHA = {"algorithm": "sha256", "columns": ["content"], "output_column": "content_hash"}


def _of(*types: str) -> str:
    return "mime_type IN (" + ", ".join(f"'{t}'" for t in types) + ") AND status = 'pending'"


def _vector(layer: str, algorithm: str, version: str, **more) -> dict:
    return {"layer": layer, "algorithm": algorithm, "dimensions": 256, "model_version": version, **more}


def _paged(kind: str, types: tuple[str, ...], extractor: str, tokens: tuple[int, int], max_df: float, weights: dict[str, float]) -> Workflow:
    """Documents with pages or sections: extracted, parsed, packed, hashed, compared with the corpus, described, vectorised."""
    least = ft.MIN_LENGTH[kind]
    tail = "id, file_id, content, segment_type, page, position, cast(length(content) / 4 as bigint) as approx_tokens"
    s = [
        Step(f"select_pending_{kind}", "filter", "_input", "s_files", _of(*types), {}, "skip_remaining"),
        Step("extract", "external", "s_files", "s_segments", None, {"extractor": extractor, "options": {}}),
        Step("parse_structure", "filter", "s_segments", "s_parsed", f"length(content) > {least}", {"min_content_length": least}),
    ]
    if kind == "docx":
        s.append(Step("build_hierarchy", "aggregate", "s_parsed", "s_sized", None, {"hierarchy_column": "parent_section_id", "level_column": "level", "path_column": "section_path"}))
    else:
        s.append(Step("count_tokens", "project", "s_parsed", "s_sized", tail))
    s += [
        Step("chunk", "window", "s_sized", "s_chunks", None, {"strategy": "semantic", "min_tokens": tokens[0], "max_tokens": tokens[1], "overlap_tokens": tokens[0]}),
        Step("compute_hash", "hash", "s_chunks", "s_hashed", None, SHA),
        Step("deduplicate", "filter", "s_hashed", "s_unique", UNSEEN),
        Step("extract_features", "aggregate", "s_unique", "s_features", None, {"features": kind}),
        Step("vectorize_structure", "vectorize", "s_features", "s_structure", None, _vector("structure", "feature_hash", f"structure_{kind}_v1", features=kind)),
        Step("vectorize_lexical", "vectorize", "s_unique", "s_lexical", None, _vector("lexical", "tfidf", "lexical_tfidf_v1", min_df=2, max_df=max_df, ngram_range=[1, 2])),
    ]
    sources = ["s_structure", "s_lexical"]
    if "contextual" in weights:
        s.append(Step("vectorize_contextual", "vectorize", "s_unique", "s_contextual", None, _vector("contextual", "graph_embed", "contextual_graph_v1", vectors="s_lexical", edges="corpus.relations", relations=["parent_of", "follows"])))
        sources.append("s_contextual")
    s += [
        Step("vectorize_blend", "vectorize", "s_unique", "s_blend", None, _vector("blend", "blend", f"blend_{kind}_v1", sources=sources, weights=weights)),
        Step("finalize_output", "project", "s_unique", "_output", "*"),
    ]
    return Workflow(f"{kind}_chunking_v1", f"{kind} to chunks and vectors", tuple(s), tags=(kind, "chunking", "vectorization", "production") if kind == "pdf" else (kind, "word", "chunking", "vectorization", "production"))


def _code(kind: str, types: tuple[str, ...], tags: tuple[str, ...], blend: dict[str, float] | None, ngrams: list[int] | None = None) -> Workflow:
    """Source files: extracted by language, long enough blocks described, hashed, compared with the corpus, vectorised."""
    keep = f"length(content) > {ft.MIN_LENGTH[kind]}" + (" AND segment_type = 'code'" if kind == "go" else "")
    s = [
        Step(f"select_{kind}_files", "filter", "_input", "s_files", _of(*types), {}, "skip_remaining"),
        Step("extract", "external", "s_files", "s_parsed", None, {"extractor": "code", "options": {"language": kind}}),
        Step("filter_meaningful", "filter", "s_parsed", "s_filtered", keep),
        Step("extract_features", "aggregate", "s_filtered", "s_features", None, {"features": kind}),
        Step("hash_content", "hash", "s_features", "s_hashed", None, SHA),
        Step("deduplicate", "filter", "s_hashed", "s_unique", UNSEEN),
        Step("vectorize_structure", "vectorize", "s_unique", "s_structure", None, _vector("structure", "feature_hash", f"{kind}_structure_v1", features=kind)),
        Step("vectorize_lexical", "vectorize", "s_unique", "s_lexical", None, _vector("lexical", "tfidf", f"{kind}_lexical_v1", **({"ngram_range": ngrams} if ngrams else {}))),
    ]
    if blend:
        s.append(Step("vectorize_blend", "vectorize", "s_unique", "s_blend", None, _vector("blend", "blend", f"{kind}_blend_v1", sources=["s_structure", "s_lexical"], weights=blend)))
    s.append(Step("finalize", "project", "s_unique", "_output", "*"))
    return Workflow(f"{kind}_chunking_v1", f"{kind} source to chunks and vectors", tuple(s), tags=tags)


def _text() -> Workflow:
    s = (
        Step("select_text_files", "filter", "_input", "s_files", _of("text/plain"), {}, "skip_remaining"),
        Step("parse_paragraphs", "external", "s_files", "s_segments", "length(content) > 10", {"extractor": "text"}),
        Step("chunk", "window", "s_segments", "s_chunks", None, {"strategy": "semantic", "min_tokens": 50, "max_tokens": 512, "overlap_tokens": 50}),
        Step("extract_features", "aggregate", "s_chunks", "s_features", None, {"features": "text"}),
        Step("hash_content", "hash", "s_features", "s_hashed", None, SHA),
        Step("deduplicate", "filter", "s_hashed", "s_unique", UNSEEN),
        Step("vectorize_lexical", "vectorize", "s_unique", "s_lexical", None, _vector("lexical", "tfidf", "text_lexical_v1")),
        Step("finalize", "project", "s_unique", "_output", "*"),
    )
    return Workflow("text_chunking_v1", "plain text to chunks and vectors", s, tags=("text", "production"))


def _search() -> Workflow:
    """Search: words of the query, their alternatives, full-text candidates, a score a layer, their weighted sum, the best."""

    def layer(name: str, before: str) -> Step:
        return Step(f"score_{name}", "join", before, f"s_{name}", None, {"table": "corpus.chunk_vectors", "layer": name, "score": "cosine", "query_vectors": "_query_vectors"})

    total = " + ".join(f"coalesce({x}_score, 0) * :w_{x}" for x in ("structure", "lexical", "contextual"))
    best = "blend_score >= :min_score ORDER BY round(blend_score, 6) DESC, id LIMIT :top_k"
    names = ", ".join(f"'{x}', {x}_score" for x in ("structure", "lexical", "contextual"))
    s = (
        Step("tokenize_query", "project", "_query_input", "s_tokens", "*, tokenize(query_text) as tokens", {"remove_stopwords": True}, "fail"),
        Step("expand_query", "project", "s_tokens", "s_expanded", "*, expand_tokens(tokens) as expanded_tokens", {"enable_synonyms": True, "max_expansion": 3}),
        Step("fts_filter", "filter", "corpus.chunks", "s_candidates", None, {"full_text": "corpus.chunk_postings", "query": "s_expanded", "stats": "_text_stats", "max_candidates": 1000}),
        layer("structure", "s_candidates"),
        layer("lexical", "s_structure"),
        layer("contextual", "s_lexical"),
        Step("blend_scores", "project", "s_contextual", "s_blended", f"*, ({total}) as blend_score", {"dynamic_weights": True}),
        Step("top_k_filter", "filter", "s_blended", "s_best", best),
        Step("enrich_results", "join", "s_best", "s_enriched", "LEFT JOIN corpus.raw_files rf ON s_best.file_id = rf.id", {"snippet_length": 200, "highlight_matches": True}),
        Step("finalize_output", "project", "s_enriched", "_output", f"id as chunk_id, blend_score as score, json_object({names}) as layer_scores, substr(content, 1, 200) as snippet, file_id, source_path"),
    )
    return Workflow("search_v1", "search over several layers", s, tags=("search", "multilayer", "production"))


def reranked(w: Workflow) -> Workflow:
    """The search workflow with blended scores multiplied by each chunk's boost, of table corpus.feedback (chunk_id, boost)."""
    out = []
    for s in w.steps:
        if s.name == "blend_scores":
            out.append(Step("join_feedback", "join", s.source, "s_boosted", "LEFT JOIN corpus.feedback fb ON s_contextual.id = fb.chunk_id"))
            s = replace(s, source="s_boosted", predicate=s.predicate.replace(") as blend_score", ") * coalesce(boost, 1.0) as blend_score"))
        out.append(s)
    return replace(w, id="search_reranked_v1", steps=tuple(out))


WORKFLOWS: dict[str, Workflow] = {
    w.id: w
    for w in (
        _paged("pdf", (MIME[".pdf"],), "pdftotext", (50, 512), 0.8, {"structure": 0.5, "lexical": 0.5}),
        _paged("docx", (MIME[".docx"], MIME[".doc"]), "docx", (30, 512), 0.85, {"structure": 0.35, "lexical": 0.35, "contextual": 0.30}),
        _code("go", ("text/x-go",), ("go", "code", "production"), {"structure": 0.4, "lexical": 0.6}, [1, 2]),
        _code("python", ("text/x-python",), ("python", "code", "production"), {"structure": 0.35, "lexical": 0.65}),
        _code("javascript", ("text/javascript", "application/javascript"), ("javascript", "js", "code", "production"), {"structure": 0.4, "lexical": 0.6}),
        _code("typescript", ("text/typescript",), ("typescript", "ts", "code", "production"), {"structure": 0.45, "lexical": 0.55}),
        _code("bash", ("text/x-sh", "application/x-sh"), ("bash", "shell", "code", "production"), None),
        _code("sql", ("text/x-sql",), ("sql", "database", "code", "production"), None),
        _code("html", ("text/html",), ("html", "htmx", "web", "production"), None),
        _code("markdown", ("text/markdown",), ("markdown", "docs", "production"), {"structure": 0.3, "lexical": 0.7}),
        _text(),
        _search(),
    )
}
