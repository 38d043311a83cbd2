"""Run labels, model slugs, failure classes and document text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import _col, base_name

# Names a label may carry after its revision.
NO_DOCS_SUFFIX = "-nodocs"
ABLATION_SUFFIX = "-abl"
BARE_CONDITION = "noskill"
DEFAULT_CONDITION = "skill"

# Sections of an instruction text that an ablation run may leave out.
ABLATION_HEADERS = {
    "definition": "## What a Logical Unit is",
    "invariants": "## The five invariants",
    "procedure": "## Procedure",
    "antipatterns": "## Anti-patterns",
    "example": "## Worked example",
    "budget": "## Budget",
}

# Fixed pattern: messages that mean an account limit rather than a broken run.
LIMIT_PATTERN = r"(?i)usage limit|rate limit|429|quota exceeded|overloaded"

LINT_ROUND_MARK = "=== lint round"


def model_slug(model) -> Column:
    """Short model name for labels: vendor prefix, date suffix and punctuation removed."""
    name = F.regexp_replace(_col(model), "^claude-", "")
    name = F.regexp_replace(name, "-[0-9]{8}$", "")
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "")


def build_label(base, model=None, condition=None, hide_docs=None, ablate=None) -> Column:
    """Label of a run from its settings; absent settings leave no suffix."""
    parts = [_col(base)]
    if model is not None:
        slug = model_slug(model)
        parts.append(F.when(F.coalesce(slug, F.lit("")) != "", F.concat(F.lit("-"), slug)))
    if condition is not None:
        cond = _col(condition)
        parts.append(F.when(cond != DEFAULT_CONDITION, F.concat(F.lit("-"), cond)))
    if hide_docs is not None:
        parts.append(F.when(_col(hide_docs).cast("int") == 1, F.lit(NO_DOCS_SUFFIX)))
    if ablate is not None:
        section = _col(ablate)
        parts.append(F.when(section != "", F.concat(F.lit(ABLATION_SUFFIX), section)))
    return F.concat_ws("", *parts)


def parse_label(label) -> Column:
    """Struct (base, model, condition, hide_docs, ablate) read back from a label."""
    label = _col(label)
    pattern = r"^([^-]+)(?:-(?!noskill$|noskill-|nodocs$|nodocs-|abl)([A-Za-z0-9]+))?(-noskill)?(-nodocs)?(?:-abl([A-Za-z]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(label, pattern, i), F.lit(""))
    return F.struct(
        F.coalesce(part(1), label).alias("base"),
        part(2).alias("model"),
        F.when(part(3).isNotNull(), F.lit(BARE_CONDITION)).otherwise(F.lit(DEFAULT_CONDITION)).alias("condition"),
        part(4).isNotNull().alias("hide_docs"),
        part(5).alias("ablate"),
    )


def classify_run(stderr, result_bytes) -> Column:
    """Outcome of one attempt: an account limit first, then a missing result, else done."""
    return (
        F.when(F.coalesce(_col(stderr), F.lit("")).rlike(LIMIT_PATTERN), F.lit("limited"))
        .when(F.coalesce(_col(result_bytes), F.lit(0)) == 0, F.lit("aborted"))
        .otherwise(F.lit("done"))
    )


def exit_code(outcome) -> Column:
    outcome = _col(outcome)
    return F.when(outcome == "limited", 4).when(outcome == "aborted", 3).otherwise(0)


def drop_section(text, header: str, mark: str = "## ") -> Column:
    """Remove every section whose heading starts with ``header``.

    The text is cut before each heading, so a section is one array element and the
    whole rule is a filter inside the row: no shuffle and no Python.
    """
    sections = F.split(_col(text), f"(?m)(?=^{_quote(mark)})")
    kept = F.filter(sections, lambda s: ~s.startswith(header))
    return F.array_join(kept, "")


def is_documentation(path) -> Column:
    """Files hidden in the no-documentation condition."""
    path = _col(path)
    name = F.lower(base_name(path))
    by_name = name.rlike(r"\.(md|rst|txt)$") | name.startswith("architecture")
    top = F.element_at(F.split(path, "/"), 1)
    in_doc_dir = path.contains("/") & top.isin("docs", "doc")
    return by_name | in_doc_dir


def lint_rounds(text) -> Column:
    """Number of lint rounds recorded in a log; 0 when there is no log."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(LINT_ROUND_MARK)), F.lit(0))


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"
