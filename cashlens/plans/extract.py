"""Statement words and texts to transactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cashlens.operators import anchors, layout, lines, rows, skew
from cashlens.operators.lines import FILE, PAGE
from cashlens.plans.staging import stage_bucketed
from cashlens.sources.files import file_text, numbered


@dataclass
class Extraction:
    texts: DataFrame
    lines: DataFrame
    placed: DataFrame
    rows: DataFrame


def processed_files(pages: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Texts of the files to process, with their upload order.

    `registry` is the result of `file_dedup`; without it every file with text is processed.
    """
    texts = file_text(pages)
    if registry is None:
        return texts
    if "upload_seq" not in pages.columns:
        raise ValueError("pages and words need upload_seq where files are given")
    kept = numbered(registry.where("duplicate_of is null")).select(*FILE)
    return texts.join(kept, FILE)


def text_lines(words: DataFrame, spread: bool = True) -> DataFrame:
    """Lines of the words that belong to a page.

    Joins by page would leave out the others later, and push a filter for that below the shuffle of the words, each its
    own: then no two of them share the shuffle.
    """
    on_page = numbered(words).dropna(subset=PAGE)
    return layout.line_states(lines.line_grouping(lines.word_dedup(on_page, spread)))


def extract(
    words: DataFrame, pages: DataFrame, registry: DataFrame | None = None, staged: bool = True
) -> Extraction:
    """All steps from words to dated rows.

    The lines are staged by page: the page states read only their narrow columns, and the
    join of states and lines finds both already partitioned. Unstaged, nothing runs before an
    action; lines are then built twice, from one shuffle of the words.
    """
    texts = processed_files(pages, registry)
    found = text_lines(words, spread=staged)
    if staged:
        found = stage_bucketed(found, "lines", PAGE, skew.spread_partitions(words))
    placed = layout.placed_lines(found, layout.page_states(found, anchors.file_facts(texts)))
    return Extraction(texts, found, placed, rows.statement_rows(placed))
