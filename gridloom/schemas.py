"""Declared schemas; nothing is inferred."""

from __future__ import annotations

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
CELL_FIELDS = "ord int, x1 int, y1 int, x2 int, y2 int, width int, height int"
