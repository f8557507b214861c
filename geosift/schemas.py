"""Schemas of the stored tables."""

from __future__ import annotations

REGISTRY = (
    "pk long, source_part int, record_id int, owner string, object_name string, waste_code string, "
    "waste_type_name string, accepts_external_waste boolean, address string, phones string, lat double, lon double, payload string"
)
#: What searches read: everything but the payload.
SEARCH_COLUMNS = [c.split()[0] for c in REGISTRY.split(", ")][:-1]
GEOCODES = "address_key string, lat double, lon double, updated_at timestamp"
META = "id int, version int, source_signature string, sources array<string>, import_sources_detail array<struct<sha256: string, part: int, name: string>>, updated_at string"
USERS = "id long, email string, password_hash string, role string, blocked boolean, subscribed boolean, created_at string, last_seen_at string"

#: Rows are the same facility to the store, or to a search, if these agree after normalising the text ones.
STORAGE_KEY = ["source_part", "record_id", "waste_code", "owner", "object_name", "address"]
SEARCH_KEY = [*STORAGE_KEY, "phones"]
