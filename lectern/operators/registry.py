"""All checks by name, with what each needs.

A check takes the parsed corpus, some also document types; it returns findings.
New checks are added with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lectern.functions.relations import Corpus
from lectern.operators import links, prose, structure, tables, wordlists

Check = Callable[[Corpus, DataFrame], DataFrame]

#: Example configuration of hubs: (hub url, patterns of page urls in its scope).
HUBS = [("/tools/hub/faqs", ["^/tools/hub-", "^/tools/server$"])]


def _plain(check: Callable[[Corpus], DataFrame]) -> Check:
    return lambda c, types: check(c)


CHECKS: dict[str, Check] = {
    "front_matter": structure.front_matter,
    "section_structure": structure.section_structure,
    "banned_phrases": _plain(wordlists.banned_phrases),
    "em_dash_semicolon": _plain(prose.em_dash_semicolon),
    "qa_headers": _plain(structure.qa_headers),
    "troubleshooting_format": _plain(structure.troubleshooting_format),
    "bare_links": _plain(structure.bare_links),
    "quick_reference_table": tables.quick_reference,
    "acronym_first_use": _plain(prose.acronym_first_use),
    "migration_specific": structure.migration_specific,
    "getting_started_specific": structure.getting_started,
    "duplicate_links": _plain(structure.duplicate_links),
    "prerequisites_links": _plain(structure.prerequisites_links),
    "try_catch": _plain(structure.try_catch),
    "duplicate_sections": _plain(structure.duplicate_sections),
    "callout_frequency": _plain(structure.callout_frequency),
    "type_mapping_row_grouping": tables.type_mapping_grouping,
    "migration_before_after": structure.migration_before_after,
    "quick_start_verification": structure.quick_start_verification,
    "sentence_concision": _plain(prose.sentence_concision),
    "metaphor_phrases": _plain(wordlists.metaphors),
    "anthropomorphism": _plain(wordlists.anthropomorphism),
    "periphrasis_phrases": _plain(wordlists.periphrasis),
    "passive_voice": _plain(wordlists.passive_voice),
    "present_continuous": _plain(prose.present_continuous),
    "error_code_format": _plain(prose.error_code_format),
    "embedded_question_phrases": _plain(prose.embedded_question),
    "retry_attempt_count_bold": _plain(prose.retry_attempt_bold),
    "ordered_list_sequence": _plain(structure.ordered_list_sequence),
    "ui_element_bold": _plain(prose.ui_element_bold),
    "additional_resource_phrasing": _plain(prose.additional_resource),
    "heading_length": _plain(structure.heading_length),
    "table_restatement": _plain(tables.table_restatement),
    "vague_reference": _plain(wordlists.vague_reference),
    "paragraph_cohesion": _plain(structure.paragraph_cohesion),
    "no_emoji": _plain(prose.no_emoji),
    "no_italics": _plain(prose.no_italics),
    "table_integrity": _plain(tables.table_integrity),
    "typographic_substitutes": _plain(prose.typographic_substitutes),
    "callout_taxonomy": lambda c, types: prose.callout_taxonomy(c, structure.cli_subjects(types)),
    "conditional_framing": _plain(prose.conditional_framing),
    "heading_uniformity": _plain(structure.heading_uniformity),
    "internal_link_form": _plain(prose.internal_link_form),
    "third_party_ui": _plain(prose.third_party_ui),
    "skimmable_sentence": _plain(prose.skimmable_sentence),
    "over_promise": _plain(wordlists.over_promise),
    "anchor_heading_level": _plain(links.anchor_heading_level),
    "bare_domain": _plain(prose.bare_domain),
    "troubleshooting_hub_pointer": lambda c, types: structure.troubleshooting_hub_pointer(c, HUBS),
    "cli_specific": structure.cli_specific,
}


def register(name: str, check: Check) -> None:
    if name in CHECKS:
        raise ValueError(f"a check named {name} exists")
    CHECKS[name] = check
