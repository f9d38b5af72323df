"""All SQL oracles."""

from __future__ import annotations

from oracles import models, reduce, ridge, spatial, tables

SQL = {**tables.SQL, **reduce.SQL, **spatial.SQL, **models.SQL, **ridge.SQL}
