"""Readers: raw CSV deliveries, stored tables, report files, manifest loads."""
