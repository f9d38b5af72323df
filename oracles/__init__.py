"""DuckDB SQL for every query with an SQL meaning, written from the definitions."""
