"""SQL counterparts of the queries for training data, where SQL can express them."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            with e as (select vector_id, input_budget, unnest(map_entries(input_files)) as e from budget_vectors),
                f as (select vector_id, input_budget, e.key as path, coalesce(e.value, '') as content from e)
            select vector_id, path from f where strlen(content) // 4 + (70 + 2 * strlen(path)) // 4 > input_budget
        """,
        "p6_found": """
            select proc_id from processed_files join encoder_configs using (config_id)
            where truncate_lines > 0 and length(content) - length(replace(content, chr(10), '')) + 1 > truncate_lines
        """,
    }
