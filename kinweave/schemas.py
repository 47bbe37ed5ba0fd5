"""Explicit schemas; nothing is inferred."""

EVENT = "struct<type: string, date: struct<raw: string, year: int, approximate: boolean>, place: string, coords: struct<lat: double, lng: double>>"
INDIVIDUALS = f"id string, seq bigint, given string, surname string, sex string, events array<{EVENT}>, famc array<string>, fams array<string>"
FAMILIES = "id string, seq bigint, husband string, wife string, children array<string>"
GAZETTEER = "ord int, names array<string>, lat double, lng double, country_code string, modern_country string"
POLITIES = "snapshot_year int, ord int, name string, subjecto string, part_of string, border_precision int, w double, s double, e double, n double"
ANCIENT = "ord int, name string, pattern string, w double, s double, e double, n double"
BORDERS = "ord int, name string, rings array<array<array<struct<lng: double, lat: double>>>>"
