"""Explicit schemas of the corpus tables; no reader infers one."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = "id long, document_number string, title string, url string, legal_type string, legal_sectors string, issuing_authority string, issuance_date string, year int, signers string, content string, plain_content string, excerpt string, source string, imported_at timestamp"
PASSAGES = "document_id long, ordinal int, heading string, text string"
PROFILES = "document_id long, heading_index string, article_index string, citation_index string, keyword_index string, chunk_count int, source_hash string"
TRACKED = "document_id long, tracked_at timestamp"
SUBJECTS = "id string, name string, slug string, source string, source_url string"
DOCUMENT_SUBJECTS = "document_id long, subject_id string"
RELATIONS = "source_document_id long, target_document_id long, relation_type string, evidence_text string, confidence string"
SECTIONS = "document_id long, ordinal int, section_type string, label string, anchor string, text string"
MENTIONS = "source_document_id long, section_ordinal int, mention_order int, raw_reference string, referenced_number string, referenced_label string, cue_phrase string, link_type string, legal_type_hint string, reference_year int, confidence string"
LINKS = "source_document_id long, section_ordinal int, mention_order int, target_document_id long, target_section_ordinal int, link_type string, score double, match_method string"
VIEWS = "id long, name string, query string, topic_slug string, legal_type string, issuer string, year int, created_at timestamp, updated_at timestamp"
RUNS = "run_id string, dataset_name string, dataset_revision string, selection_mode string, notes string, scanned_count long, imported_count long, skipped_count long, event string, at timestamp"

#: Columns of the raw Parquet files.
METADATA = "id long, title string, ngay_ban_hanh string, so_ky_hieu string, loai_van_ban string, co_quan_ban_hanh string, nganh string, linh_vuc string, nguon_thu_thap string, chuc_danh string, nguoi_ky string"
CONTENT = "id long, content_html string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)
