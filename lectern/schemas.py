"""Contracts of the tables that are written."""

LOCATOR = "struct<type:string,physical_page_start:int,physical_page_end:int,page_label_start:string,page_label_end:string,page_source:string,chapter:string,paragraph_pages:array<struct<offset:int,label:string>>,cfi_start:string,cfi_end:string>"
INDEX = f"chunk_id string, chunk_ref string, snapshot_id string, document_id string, attachment_id string, chunk_index int, text string, locator {LOCATOR}, section_titles array<string>, token_count int, embedding array<float>, sparse map<string,double>"
ENTITY = "id string, form string, type string, alias_of string"
MENTION = "entity_id string, chunk_id string"
RELATION = "id string, source string, target string, type string, strength double, evidence array<string>"
SNAPSHOT = "id string, attachment_id string, document_id string, active boolean, created_at timestamp"
JOB_STATUS = ("pending", "claimed", "processing", "completed", "failed", "cancelled", "obsolete")
PAGE_SOURCES = ("folio_verified", "pdf_label_sane", "physical_only", "blind", "none")
