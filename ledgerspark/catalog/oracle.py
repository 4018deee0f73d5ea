"""The registered queries again, as plain SQL over the driver's tables.

Written apart from the Spark code, as the check of it. ``CTES`` are the ledger views in
SQL; a query names those it needs.
"""

from __future__ import annotations

import re


AS_OF = "DATE '1998-06-15'"

CTES = {
    "ws": "SELECT CAST(n_nationkey AS VARCHAR) AS workspace_id, n_name AS name FROM nation",
    "sales": """
        SELECT CAST(s_nationkey AS VARCHAR) AS workspace_id,
               l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
               CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS sku,
               p_name AS name, p_type AS category, CAST(l_quantity AS INT) AS quantity,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS amount_inr,
               CASE WHEN l_returnflag <> 'N'
                    THEN CAST(round((l_discount + l_tax) * 100, 2) AS DECIMAL(6,2)) END AS margin_pct,
               l_shipdate AS created_at, l_linestatus
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "purchases": """
        SELECT CAST(s_nationkey AS VARCHAR) AS workspace_id,
               l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
               CAST(l_shipdate AS DATE) AS date, s_name AS supplier_name,
               CAST(l_partkey AS VARCHAR) AS sku, CAST(l_quantity AS INT) AS quantity,
               CAST(l_quantity * 10 AS DECIMAL(12,2)) AS amount_inr, l_shipdate AS created_at
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "products": f"""
        SELECT CAST(p_partkey % 25 AS VARCHAR) AS workspace_id, CAST(p_partkey AS VARCHAR) AS sku,
               p_name AS name, p_type AS category,
               CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price_inr,
               p_size AS quantity_on_hand,
               CASE WHEN p_partkey % 7 <> 0
                    THEN {AS_OF} + CAST(p_partkey % 121 - 10 AS INT) END AS expires_on,
               DATE '1998-01-01' + p_size AS created_at
        FROM part""",
    "expenses": """
        SELECT CAST(user_id % 25 AS VARCHAR) AS workspace_id, CAST(event_id AS VARCHAR) AS id,
               CAST(ts AS DATE) AS occurred_on, 'user-' || user_id AS label,
               CASE event_type WHEN 'error' THEN 'Utilities' WHEN 'click' THEN 'Operations'
                    ELSE event_type END AS category,
               CAST(value AS DECIMAL(12,2)) AS amount_inr, ts AS created_at, event_type
        FROM events""",
    "orderz": """
        SELECT CAST(c_nationkey AS VARCHAR) AS workspace_id, o.*
        FROM orders o JOIN customer ON o_custkey = c_custkey""",
    "obligations": """
        SELECT workspace_id, CAST(o_orderkey AS VARCHAR) AS id,
               o_orderpriority || '-' || o_orderkey AS label,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Supplier' WHEN '2-HIGH' THEN 'Utilities'
                    ELSE 'Facility' END AS category,
               CAST(o_totalprice AS DECIMAL(12,2)) AS amount_inr,
               CAST(o_orderdate AS DATE) AS due_date,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'due' ELSE 'scheduled' END AS status,
               CASE o_orderkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'annual' END AS recurrence,
               CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 0 ELSE 1 END AS status_rank,
               o_orderdate AS created_at
        FROM orderz""",
    "docs": f"""
        SELECT CAST(doc_id % 25 AS VARCHAR) AS workspace_id, CAST(doc_id AS VARCHAR) AS document_id,
               source || '-' || doc_id AS title, lang AS kind, text AS summary,
               {AS_OF} - CAST(n_chars % 365 AS INT) AS uploaded_at
        FROM documents""",
    "questions": """
        SELECT CAST(conv_id % 25 AS VARCHAR) AS workspace_id, conv_id || '-' || turn AS question_id,
               list_extract(['Why did profit drop this month?',
                 'What are my TOP products that sell best?', 'Which expense is highest?',
                 'Did an expense spike; why?', 'Forecast and predict why sales moved',
                 'Investigate margin', 'delete me -- please', 'What dropped?',
                 'Please grant access', ''], CAST((conv_id + turn) % 10 + 1 AS INT)) || ' ' || text AS question
        FROM conversations WHERE role = 'user'""",
    "classified": """
        SELECT *,
               contains(q, 'drop ') OR contains(q, 'delete ') OR contains(q, 'truncate ')
                 OR contains(q, 'alter ') OR contains(q, 'grant ') OR contains(q, 'revoke ')
                 OR contains(q, ';') OR contains(q, '--') AS refused,
               CASE WHEN contains(q, 'forecast') OR contains(q, 'predict') THEN 'recommend'
                    WHEN contains(q, 'why') OR contains(q, 'drop') OR contains(q, 'investigate')
                    THEN 'investigate' ELSE 'summarize' END AS task,
               CASE WHEN contains(q, 'top') AND contains(q, 'product') AND contains(q, 'sell')
                    THEN 'top_products'
                    WHEN contains(q, 'expense') AND (contains(q, 'highest') OR contains(q, 'spike'))
                    THEN 'top_expenses' END AS route
        FROM (SELECT *, lower(question) AS q FROM questions)""",
    "jobs": """
        SELECT workspace_id, CAST(o_orderkey AS VARCHAR) AS job_id,
               CASE WHEN o_orderstatus = 'P' THEN 'inventory'
                    WHEN o_orderpriority = '1-URGENT' THEN 'sales'
                    WHEN o_orderpriority = '2-HIGH' THEN 'purchases'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'products'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'expenses'
                    ELSE 'recurring_obligations' END AS import_type,
               'export-' || o_orderkey || '.csv' AS filename, coalesce(n, 0) AS row_count,
               CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'pending' END AS status,
               CASE WHEN o_orderstatus = 'F' THEN coalesce(n, 0) ELSE 0 END AS applied_count,
               CAST(o_orderdate AS DATE) AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 1 END AS confirmed_at,
               o_orderkey
        FROM orderz LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
          ON o_orderkey = l_orderkey""",
    "affected": """
        SELECT * FROM (VALUES ('sales', 'sales|dashboard|action_queue'),
          ('purchases', 'purchases|dashboard|action_queue'), ('products', 'products|dashboard'),
          ('expenses', 'expenses|dashboard|action_queue'),
          ('recurring_obligations', 'recurring_obligations|dashboard'),
          ('inventory', 'inventory')) t(import_type, names)""",
    "upload_lines": """
        SELECT workspace_id, job_id, import_type, filename, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
               l_quantity = 1 AS blank,
               CASE WHEN l_linenumber = 7 THEN ''
                    WHEN l_returnflag = 'R' THEN year(l_shipdate) || '-' || month(l_shipdate) || '-' || day(l_shipdate)
                    WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN '2026-02-30'
                    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day_text,
               CASE WHEN l_linestatus = 'F' THEN ''
                    ELSE CAST(CAST(l_shipdate AS DATE) + 1 AS VARCHAR) END AS later,
               CAST(l_partkey AS VARCHAR) AS sku,
               CASE WHEN l_linenumber = 3 THEN 'abc' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS cnt,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || '5' AS amount,
               CASE WHEN l_returnflag <> 'N'
                    THEN CAST(CAST(round((l_discount + l_tax) * 100, 2) AS DECIMAL(6,2)) AS VARCHAR) END AS margin,
               CASE WHEN l_linenumber <> 4 THEN 'line-' || l_partkey END AS label,
               l_returnflag AS flag, l_linestatus AS line_status, l_suppkey AS supp
        FROM lineitem JOIN jobs ON l_orderkey = o_orderkey""",
    "cells": """
        SELECT workspace_id, job_id, import_type, filename, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
               u.p AS pos, u.h AS header, CASE WHEN blank THEN '' ELSE u.v END AS value
        FROM (SELECT *, unnest(CASE import_type
          WHEN 'sales' THEN [{'p': 0, 'h': ' Date ', 'v': day_text}, {'p': 1, 'h': 'SKU', 'v': sku},
            {'p': 2, 'h': 'Product Name', 'v': label}, {'p': 3, 'h': 'category', 'v': flag},
            {'p': 4, 'h': 'Qty', 'v': cnt}, {'p': 5, 'h': 'Revenue INR', 'v': amount},
            {'p': 6, 'h': 'amount_inr', 'v': 'x'}, {'p': 7, 'h': 'margin_pct', 'v': margin}]
          WHEN 'purchases' THEN [{'p': 0, 'h': 'Date', 'v': day_text},
            {'p': 1, 'h': 'Supplier', 'v': CAST(supp AS VARCHAR)}, {'p': 2, 'h': 'SKU', 'v': sku},
            {'p': 3, 'h': 'quantity', 'v': cnt}, {'p': 4, 'h': 'amount_inr', 'v': ' ' || amount || ' '},
            {'p': 5, 'h': 'date', 'v': later}]
          WHEN 'products' THEN [{'p': 0, 'h': 'sku', 'v': CASE WHEN l_linenumber = 5 THEN '  ' ELSE sku END},
            {'p': 1, 'h': 'name', 'v': label}, {'p': 2, 'h': 'unit_price_inr', 'v': amount},
            {'p': 3, 'h': 'quantity_on_hand', 'v': cnt}, {'p': 4, 'h': 'expires_on', 'v': later},
            {'p': 5, 'h': 'Shelf', 'v': 's'}]
          WHEN 'expenses' THEN [{'p': 0, 'h': 'date', 'v': day_text}, {'p': 1, 'h': 'label', 'v': label},
            {'p': 2, 'h': 'Category', 'v': CASE WHEN l_linenumber = 6 THEN '' ELSE flag END},
            {'p': 3, 'h': 'amount_inr', 'v': CASE WHEN l_linenumber = 2 THEN '5d' ELSE amount END}]
          WHEN 'recurring_obligations' THEN [{'p': 0, 'h': 'Label', 'v': label},
            {'p': 1, 'h': 'category', 'v': flag}, {'p': 2, 'h': 'amount_inr', 'v': amount},
            {'p': 3, 'h': 'due_date', 'v': day_text},
            {'p': 4, 'h': 'Recurrence', 'v': CASE WHEN line_status = 'F' THEN 'annual' ELSE 'weekly' END},
            {'p': 5, 'h': 'Status', 'v': CASE WHEN flag = 'A' THEN 'due' ELSE 'open' END}]
          ELSE [{'p': 0, 'h': 'sku', 'v': sku}, {'p': 1, 'h': 'count', 'v': cnt}] END) AS u
        FROM upload_lines)""",
    "aliases": """
        SELECT * FROM (VALUES
          ('sales', 'date', 'date'), ('sales', 'sku', 'sku'), ('sales', 'product_name', 'name'),
          ('sales', 'category', 'category'), ('sales', 'qty', 'quantity'),
          ('sales', 'revenue_inr', 'amount_inr'), ('sales', 'margin_pct', 'margin_pct'),
          ('purchases', 'date', 'date'), ('purchases', 'supplier', 'supplier_name'),
          ('purchases', 'sku', 'sku'), ('purchases', 'quantity', 'quantity'),
          ('purchases', 'amount_inr', 'amount_inr'),
          ('products', 'sku', 'sku'), ('products', 'name', 'name'), ('products', 'category', 'category'),
          ('products', 'unit_price_inr', 'unit_price_inr'),
          ('products', 'quantity_on_hand', 'quantity_on_hand'), ('products', 'expires_on', 'expires_on'),
          ('expenses', 'date', 'occurred_on'), ('expenses', 'label', 'label'),
          ('expenses', 'category', 'category'), ('expenses', 'amount_inr', 'amount_inr'),
          ('recurring_obligations', 'label', 'label'), ('recurring_obligations', 'category', 'category'),
          ('recurring_obligations', 'amount_inr', 'amount_inr'),
          ('recurring_obligations', 'due_date', 'due_date'),
          ('recurring_obligations', 'recurrence', 'recurrence'),
          ('recurring_obligations', 'status', 'status')) t(import_type, alias, target)""",
    "mapped": """
        SELECT c.*, coalesce(a.target, 'review_manually') AS target
        FROM cells c LEFT JOIN aliases a ON a.import_type = c.import_type
          AND a.alias = replace(lower(trim(c.header)), ' ', '_')""",
    "payload": """
        SELECT job_id, import_type, workspace_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, target,
               max_by(value, pos) AS raw
        FROM mapped WHERE target <> 'review_manually' AND value IS NOT NULL AND value <> ''
        GROUP BY ALL""",
    "rows_kept": """
        SELECT job_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
               row_number() OVER (PARTITION BY job_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS row_index
        FROM (SELECT DISTINCT job_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM payload)""",
    "staged": """
        SELECT p.job_id, p.import_type, p.workspace_id, r.row_index, p.target,
               CASE WHEN p.target IN ('amount_inr', 'unit_price_inr', 'margin_pct')
                     AND regexp_full_match(p.raw, '[+-]?[0-9]*[.][0-9]+')
                    THEN CAST(round(CAST(p.raw AS DECIMAL(38,6)), 2)::DECIMAL(38,2) AS VARCHAR)
                    ELSE p.raw END AS value
        FROM payload p JOIN rows_kept r USING (job_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)""",
    "wide": """
        SELECT workspace_id, job_id, import_type, row_index,
               max(CASE WHEN target = 'date' THEN value END) AS date,
               max(CASE WHEN target = 'occurred_on' THEN value END) AS occurred_on,
               max(CASE WHEN target = 'due_date' THEN value END) AS due_date,
               max(CASE WHEN target = 'expires_on' THEN value END) AS expires_on,
               max(CASE WHEN target = 'sku' THEN value END) AS sku,
               max(CASE WHEN target = 'name' THEN value END) AS name,
               max(CASE WHEN target = 'label' THEN value END) AS label,
               max(CASE WHEN target = 'category' THEN value END) AS category,
               max(CASE WHEN target = 'supplier_name' THEN value END) AS supplier_name,
               max(CASE WHEN target = 'quantity' THEN value END) AS quantity,
               max(CASE WHEN target = 'quantity_on_hand' THEN value END) AS quantity_on_hand,
               max(CASE WHEN target = 'amount_inr' THEN value END) AS amount_inr,
               max(CASE WHEN target = 'unit_price_inr' THEN value END) AS unit_price_inr,
               max(CASE WHEN target = 'margin_pct' THEN value END) AS margin_pct,
               max(CASE WHEN target = 'recurrence' THEN value END) AS recurrence,
               max(CASE WHEN target = 'status' THEN value END) AS status
        FROM staged GROUP BY ALL""",
    "typed": f"""
        SELECT workspace_id, job_id, import_type, row_index,
               CAST(CASE WHEN date IS NULL THEN {AS_OF} ELSE try_cast(date AS DATE) END AS VARCHAR) AS date,
               CAST(CASE WHEN occurred_on IS NULL THEN {AS_OF} ELSE try_cast(occurred_on AS DATE) END AS VARCHAR) AS occurred_on,
               CAST(CASE WHEN due_date IS NULL THEN {AS_OF} ELSE try_cast(due_date AS DATE) END AS VARCHAR) AS due_date,
               CAST(try_cast(expires_on AS DATE) AS VARCHAR) AS expires_on,
               CASE WHEN import_type = 'products' THEN trim(coalesce(sku, '')) ELSE coalesce(sku, 'UNKNOWN') END AS sku,
               CASE WHEN import_type = 'products' THEN coalesce(name, trim(sku)) ELSE name END AS name,
               coalesce(label, CASE WHEN import_type = 'expenses' THEN 'Expense entry' ELSE 'Imported obligation' END) AS label,
               coalesce(category, CASE import_type WHEN 'products' THEN 'General' WHEN 'sales' THEN NULL ELSE 'Operations' END) AS category,
               coalesce(supplier_name, 'Unknown supplier') AS supplier_name,
               CAST(coalesce(CAST(trunc(try_cast(quantity AS DOUBLE)) AS INT), 1) AS VARCHAR) AS quantity,
               CAST(coalesce(CAST(trunc(try_cast(quantity_on_hand AS DOUBLE)) AS INT), 0) AS VARCHAR) AS quantity_on_hand,
               CAST(coalesce(try_cast(trim(amount_inr) AS DECIMAL(12,2)), 0) AS VARCHAR) AS amount_inr,
               CAST(coalesce(try_cast(trim(unit_price_inr) AS DECIMAL(12,2)), 0) AS VARCHAR) AS unit_price_inr,
               CASE WHEN margin_pct IS NOT NULL THEN CAST(coalesce(try_cast(margin_pct AS DECIMAL(6,2)), 0) AS VARCHAR) END AS margin_pct,
               CASE WHEN recurrence IN ('monthly', 'quarterly', 'annual') THEN recurrence ELSE 'monthly' END AS recurrence,
               CASE WHEN status IN ('due', 'paid', 'scheduled') THEN status ELSE 'scheduled' END AS status
        FROM wide WHERE import_type <> 'products' OR trim(coalesce(sku, '')) <> ''""",
    "requested": """
        SELECT workspace_id, job_id FROM jobs
        UNION SELECT workspace_id, 'missing-' || sku FROM products""",
    "daily": """
        SELECT workspace_id, 'sales' AS import_type, date AS day, sum(amount_inr) AS daily_total
        FROM sales GROUP BY ALL
        UNION ALL SELECT workspace_id, 'purchases', date, sum(amount_inr) FROM purchases GROUP BY ALL
        UNION ALL SELECT workspace_id, 'expenses', occurred_on, sum(amount_inr) FROM expenses GROUP BY ALL""",
    "averages": """
        SELECT workspace_id, import_type, CAST(sum(daily_total) AS DOUBLE) / count(*) AS average
        FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, import_type ORDER BY day DESC) AS n FROM daily)
        WHERE n <= 5 GROUP BY ALL""",
    "unpaid": f"""
        SELECT *, date_diff('day', {AS_OF}, due_date) AS days
        FROM obligations WHERE status <> 'paid'""",
    "soonest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id
          ORDER BY days, status_rank, due_date, label, id) AS ord FROM unpaid) WHERE ord <= 3""",
    "expiring": f"SELECT * FROM products WHERE expires_on <= {AS_OF} + 45",
    "due_soon": "SELECT * FROM unpaid WHERE days BETWEEN 0 AND 10",
    "facts": """
        SELECT ws.workspace_id,
               coalesce(CAST(s.revenue AS DOUBLE), 0) AS total_revenue, coalesce(s.margin, 0) AS avg_margin,
               coalesce(CAST(b.total AS DOUBLE), 0) AS total_due, b.labels,
               coalesce(x.lots, 0) AS lot_count, coalesce(CAST(x.exposure AS DOUBLE), 0) AS exposure,
               coalesce(e.utility_avg, 0) AS utility_avg,
               coalesce(CAST(o.recurring_due AS DOUBLE), 0) AS recurring_due,
               coalesce(CAST(o.top_supplier_due AS DOUBLE), 0) AS top_supplier_due
        FROM ws
        LEFT JOIN (SELECT workspace_id, sum(amount_inr) AS revenue,
                          CAST(sum(margin_pct) AS DOUBLE) / count(margin_pct) AS margin
                   FROM sales GROUP BY 1) s ON s.workspace_id = ws.workspace_id
        LEFT JOIN (SELECT workspace_id, sum(amount_inr) AS total,
                          string_agg(label, ', ' ORDER BY n) FILTER (n <= 3) AS labels
                   FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id
                           ORDER BY status_rank, due_date, label, id) AS n FROM due_soon)
                   GROUP BY 1) b ON b.workspace_id = ws.workspace_id
        LEFT JOIN (SELECT workspace_id, count(*) AS lots, sum(unit_price_inr * quantity_on_hand) AS exposure
                   FROM expiring GROUP BY 1) x ON x.workspace_id = ws.workspace_id
        LEFT JOIN (SELECT workspace_id, CAST(sum(amount_inr) AS DOUBLE) / count(*) AS utility_avg
                   FROM expenses WHERE lower(category) = 'utilities' GROUP BY 1) e
          ON e.workspace_id = ws.workspace_id
        LEFT JOIN (SELECT workspace_id, sum(amount_inr) AS recurring_due,
                          max(CASE WHEN lower(category) = 'supplier' THEN amount_inr END) AS top_supplier_due
                   FROM unpaid GROUP BY 1) o ON o.workspace_id = ws.workspace_id""",
    "top_skus": """
        SELECT * FROM (SELECT workspace_id, sku, revenue, row_number() OVER (PARTITION BY workspace_id
            ORDER BY revenue DESC, sku) AS ord
          FROM (SELECT workspace_id, sku, sum(amount_inr) AS revenue FROM sales GROUP BY ALL))
        WHERE ord <= 3""",
    "top_categories": """
        SELECT * FROM (SELECT workspace_id, category, expense_total, row_number() OVER (PARTITION BY workspace_id
            ORDER BY expense_total DESC, category) AS ord
          FROM (SELECT workspace_id, category, sum(amount_inr) AS expense_total FROM expenses GROUP BY ALL))
        WHERE ord <= 3""",
    "insights": """
        SELECT ws.workspace_id,
               coalesce('Top selling SKUs by revenue are ' || p.parts || '.',
                        'No sales rows are available yet for a top-product summary.') AS top_products,
               coalesce('Highest expense categories right now are ' || c.parts || '.',
                        'No expense rows are available yet for category analysis.') AS top_expenses
        FROM ws
        LEFT JOIN (SELECT workspace_id, string_agg(sku || ' (' || {short:CAST(revenue AS DOUBLE)} || ')', ', ' ORDER BY ord) AS parts
                   FROM top_skus GROUP BY 1) p ON p.workspace_id = ws.workspace_id
        LEFT JOIN (SELECT workspace_id, string_agg(category || ' (' || {short:CAST(expense_total AS DOUBLE)} || ')', ', ' ORDER BY ord) AS parts
                   FROM top_categories GROUP BY 1) c ON c.workspace_id = ws.workspace_id""",
    "alerts": """
        SELECT workspace_id, 1 AS ord, 'expiry-' || sku AS id, name || ' needs expiry attention' AS title,
               'SKU ' || sku || ' expires on ' || CAST(expires_on AS VARCHAR) || ' with '
                 || quantity_on_hand || ' units on hand.' AS detail, 'warning' AS severity
        FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY expires_on, sku) AS n FROM expiring)
        WHERE n = 1
        UNION ALL
        SELECT workspace_id, 2, 'cash-watch', 'Recurring obligations are now DB-backed and live',
               'Use quick-add entries to keep daily sales, purchases, and expenses decision-ready.', 'info'
        FROM ws""",
    "stats": """
        SELECT workspace_id, 1 AS ord, 'Monthly revenue' AS label, total_revenue AS number,
               {short:total_revenue} AS value, 'Computed from imported and quick-added sales rows' AS delta,
               CASE WHEN total_revenue > 0 THEN 'positive' ELSE 'neutral' END AS tone FROM facts
        UNION ALL
        SELECT workspace_id, 2, 'Gross margin', avg_margin,
               printf('%.1f%%', CAST(round(CAST(avg_margin AS DECIMAL(20,10)), 1) AS DOUBLE)),
               'Average of tracked sale-level margin entries',
               CASE WHEN avg_margin < 24 THEN 'warning' ELSE 'positive' END FROM facts
        UNION ALL
        SELECT workspace_id, 3, 'Bills due in 10 days', total_due, {short:total_due},
               coalesce(labels, 'No recurring bills due soon'),
               CASE WHEN total_due <> 0 THEN 'critical' ELSE 'neutral' END FROM facts
        UNION ALL
        SELECT workspace_id, 4, 'Near-expiry inventory', exposure, {short:exposure},
               lot_count || ' lots inside 45-day watch window',
               CASE WHEN lot_count > 0 THEN 'warning' ELSE 'neutral' END FROM facts""",
    "import_candidates": """
        SELECT workspace_id, 'import-' || job_id AS id,
               'Review the latest ' || replace(import_type, '_', ' ') || ' import' AS title,
               applied_count || ' rows from ' || filename || ' were added on ' || CAST(confirmed_at AS VARCHAR)
                 || '. Use this ledger in the next investigation.' AS detail,
               'info' AS severity, 'review_import' AS action_type, import_type AS target_entity,
               'watching' AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id
                ORDER BY confirmed_at DESC, created_at DESC, job_id) AS n
              FROM jobs WHERE status = 'confirmed') WHERE n <= 2""",
    "bill_candidates": """
        SELECT workspace_id,
               CASE WHEN category = 'Supplier' THEN 'draft-' ELSE 'obligation-' END || id AS id,
               CASE WHEN category = 'Supplier' THEN 'Stage supplier follow-up for '
                    ELSE 'Protect cash for ' END || label AS title,
               CASE WHEN category = 'Supplier'
                    THEN {full:amount_inr} || ' is due on ' || CAST(due_date AS VARCHAR)
                      || '. Prepare a message before the next payment cycle tightens cash.'
                    ELSE {full:amount_inr} || ' is ' || CASE WHEN days < 0 THEN 'overdue'
                      ELSE 'due in ' || days || ' days' END
                      || ' and should stay visible in the owner plan.' END AS detail,
               CASE WHEN days <= CASE WHEN category = 'Supplier' THEN 3 ELSE 2 END
                    THEN 'critical' ELSE 'warning' END AS severity,
               CASE WHEN category = 'Supplier' THEN 'vendor_follow_up' ELSE 'bill_review' END AS action_type,
               label AS target_entity, 'open' AS status
        FROM soonest""",
    "found_candidates": "SELECT * FROM bill_candidates UNION ALL SELECT * FROM import_candidates",
    "candidates": """
        SELECT * FROM found_candidates
        UNION ALL
        SELECT workspace_id, 'watch-stock', 'No urgent actions. Keep tracking slow-moving stock.',
               'Your current obligations look stable. Use quick-add entries to keep decisions up to date.',
               'info', 'watchlist', 'Current workspace', 'watching'
        FROM ws WHERE workspace_id NOT IN (SELECT workspace_id FROM found_candidates)""",
    "stored_actions": """
        SELECT workspace_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'draft-' ELSE 'obligation-' END || o_orderkey AS id,
               'Old title ' || o_orderkey AS title, 'Old detail' AS detail, 'info' AS severity,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'vendor_follow_up' ELSE 'bill_review' END AS action_type,
               'order_' || o_orderkey AS target_entity,
               CASE o_orderpriority WHEN '2-HIGH' THEN 'watching' WHEN '3-MEDIUM' THEN 'snoozed'
                    WHEN '4-NOT SPECIFIED' THEN 'resolved' ELSE 'open' END AS status,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN '1998-07-01' END AS snoozed_until,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'done' END AS resolution_note,
               o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orderz""",
    "queue": """
        SELECT coalesce(s.workspace_id, c.workspace_id) AS workspace_id, coalesce(s.id, c.id) AS id,
               coalesce(c.title, s.title) AS title, coalesce(c.detail, s.detail) AS detail,
               coalesce(c.severity, s.severity) AS severity,
               coalesce(c.action_type, s.action_type) AS action_type,
               coalesce(c.target_entity, s.target_entity) AS target_entity,
               coalesce(s.status, c.status) AS status, s.snoozed_until, s.resolution_note,
               CASE WHEN s.id IS NULL THEN TIMESTAMP '1998-06-15 12:00:00' ELSE s.created_at END AS created_at,
               CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '1998-06-15 12:00:00' ELSE s.updated_at END AS updated_at
        FROM stored_actions s
        FULL JOIN candidates c ON s.workspace_id = c.workspace_id AND s.id = c.id
        WHERE NOT (c.id IS NULL AND s.status IN ('open', 'watching'))""",
    "queue_ranked": """
        SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY
                 CASE status WHEN 'open' THEN 0 WHEN 'watching' THEN 1 WHEN 'snoozed' THEN 2 ELSE 3 END,
                 updated_at DESC, id) AS n
        FROM queue""",
    "chunked": r"""
        SELECT workspace_id, document_id, list_filter(list_transform(
                 regexp_extract_all({squeeze:summary}, '(?s).{1,280}'), lambda x: trim(x)), lambda x: x <> '') AS parts
        FROM docs""",
    "chunks": """
        SELECT workspace_id, document_id, CAST(n AS INT) - 1 AS chunk_index, parts[n] AS content
        FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM chunked)""",
    "chunk_vectors": """
        {vectors:chunks:workspace_id, document_id, chunk_index:content}""",
    "question_vectors": """
        {vectors:questions:workspace_id, question_id:question}""",
    "nearest": """
        SELECT workspace_id, question_id, document_id, chunk_index, distance,
               row_number() OVER (PARTITION BY workspace_id, question_id
                 ORDER BY distance IS NULL, distance, document_id, chunk_index) AS ord
        FROM (SELECT q.workspace_id, q.question_id, c.document_id, c.chunk_index,
                     round(1 - list_inner_product(q.unit, c.unit), 12) + 0.0 AS distance
              FROM (SELECT workspace_id, question_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS unit FROM question_vectors) q
              JOIN (SELECT workspace_id, document_id, chunk_index, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS unit FROM chunk_vectors) c
                ON q.workspace_id = c.workspace_id)""",
    "cited": """
        SELECT n.workspace_id, n.question_id, n.ord, 'Document: ' || d.title AS label,
               c.content AS detail, d.title AS source
        FROM nearest n JOIN chunks c USING (workspace_id, document_id, chunk_index)
        JOIN docs d ON d.workspace_id = n.workspace_id AND d.document_id = n.document_id
        WHERE n.ord <= 2""",
    "ws_settings": """
        SELECT CAST(n_nationkey AS VARCHAR) AS workspace_id,
               CASE n_regionkey WHEN 0 THEN 'hybrid' WHEN 1 THEN 'byo-cloud' WHEN 2 THEN 'byo-cloud'
                    ELSE 'local-open' END AS mode,
               CASE WHEN n_regionkey <> 2 THEN 'first' END AS first_name,
               CASE WHEN n_regionkey <> 2 THEN lower(n_name) END AS last_name
        FROM nation""",
    "routed": """
        SELECT c.*, s.mode,
               CASE WHEN s.mode = 'local-open' THEN 'ollama-local'
                    WHEN s.mode = 'byo-cloud' AND task = 'investigate' THEN coalesce(first_name, 'openai')
                    WHEN s.mode = 'byo-cloud' THEN coalesce(last_name, 'openrouter')
                    WHEN task = 'investigate' THEN coalesce(first_name, 'ollama-local')
                    ELSE 'ollama-local' END AS provider
        FROM classified c JOIN ws_settings s USING (workspace_id)""",
    "priced": """
        SELECT *, CASE WHEN provider = 'ollama-local' THEN 0.0::DOUBLE ELSE {dec6:
                 CASE task WHEN 'summarize' THEN 0.0008::DOUBLE WHEN 'investigate' THEN 0.0032::DOUBLE
                      ELSE 0.0021::DOUBLE END * (greatest(length(question), 40) / 2200::DOUBLE)} END AS cost
        FROM routed""",
    "obligation_changes": """
        SELECT workspace_id, CAST(o_orderkey AS VARCHAR) AS entity_id, event_type, ts, event_id AS change_id
        FROM events JOIN orderz ON user_id = o_custkey
        UNION ALL
        SELECT CAST(user_id % 25 AS VARCHAR), 'unknown-' || user_id, event_type, ts, event_id
        FROM events WHERE event_type = 'error'""",
    "action_changes": """
        SELECT workspace_id, 'obligation-' || o_orderkey AS entity_id, event_type, ts, event_id AS change_id
        FROM events JOIN orderz ON user_id = o_custkey
        UNION ALL
        SELECT CAST(user_id % 25 AS VARCHAR), 'unknown-' || user_id, event_type, ts, event_id
        FROM events WHERE event_type = 'error'""",
    "members": """
        SELECT CAST(c_nationkey AS VARCHAR) AS workspace_id, CAST(c_custkey AS VARCHAR) AS user_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'owner' WHEN 'HOUSEHOLD' THEN 'owner'
                    WHEN 'BUILDING' THEN 'manager' WHEN 'FURNITURE' THEN 'accountant' ELSE 'guest' END AS role,
               DATE '1990-01-01' + CAST(c_custkey % 1000 AS INT) AS created_at
        FROM customer""",
    "role_changes": """
        SELECT o_orderkey AS change_id, z.workspace_id, CAST(o_custkey AS VARCHAR) AS requester_id,
               CAST(CASE o_orderpriority WHEN '2-HIGH' THEN f WHEN '3-MEDIUM' THEN l
                    WHEN '4-NOT SPECIFIED' THEN o_orderkey + 1000000000 ELSE o_custkey END AS VARCHAR) AS user_id,
               CASE o_orderstatus WHEN 'F' THEN 'owner' WHEN 'O' THEN 'manager' ELSE 'boss' END AS role
        FROM orderz z JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS workspace_id, min(c_custkey) AS f,
                                   max(c_custkey) AS l FROM customer GROUP BY 1) e
          ON e.workspace_id = z.workspace_id""",
    "role_chains": """
        SELECT o_orderkey AS change_id, z.workspace_id, CAST(o_custkey AS VARCHAR) AS requester_id,
               CAST(CASE o_orderpriority WHEN '3-MEDIUM' THEN o_custkey
                    WHEN '4-NOT SPECIFIED' THEN o_orderkey + 1000000000
                    ELSE coalesce(captain, o_custkey) END AS VARCHAR) AS user_id,
               CASE o_orderstatus WHEN 'F' THEN 'owner' WHEN 'O' THEN 'manager' ELSE 'boss' END AS role
        FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey + 1 WHEN '2-HIGH' THEN o_orderkey
                             ELSE o_custkey + 2 END % 5 AS slot FROM orderz) z
        LEFT JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS workspace_id, c_custkey % 5 AS slot,
                          min(c_custkey) AS captain FROM customer GROUP BY 1, 2) e
          ON e.workspace_id = z.workspace_id AND e.slot = z.slot""",
    "judged": """
        SELECT c.*, CASE WHEN coalesce(r.role, '') <> 'owner' THEN 'not_owner'
                         WHEN c.role NOT IN ('owner', 'manager', 'accountant') THEN 'invalid_role'
                         WHEN c.requester_id = c.user_id AND c.role <> 'owner' THEN 'self_demotion'
                         WHEN t.user_id IS NULL THEN 'member_not_found' ELSE 'applied' END AS outcome
        FROM role_changes c
        LEFT JOIN members r ON r.workspace_id = c.workspace_id AND r.user_id = c.requester_id
        LEFT JOIN members t ON t.workspace_id = c.workspace_id AND t.user_id = c.user_id""",
    "merged_products": """
        SELECT coalesce(t.workspace_id, s.workspace_id) AS workspace_id, coalesce(t.sku, s.sku) AS sku,
               CASE WHEN s.sku IS NULL THEN t.name ELSE s.name END AS name,
               CASE WHEN s.sku IS NULL THEN t.category ELSE s.category END AS category,
               CAST(CASE WHEN s.sku IS NULL THEN t.unit_price_inr ELSE s.price END AS DOUBLE) AS unit_price_inr,
               CASE WHEN s.sku IS NULL THEN t.quantity_on_hand ELSE s.qty END AS quantity_on_hand,
               CAST(CASE WHEN s.sku IS NULL THEN t.expires_on ELSE s.expires_on END AS VARCHAR) AS expires_on,
               CAST(CASE WHEN t.sku IS NULL THEN s.created_at ELSE t.created_at END AS VARCHAR) AS created_on
        FROM products t FULL JOIN (
          SELECT * FROM (
            SELECT CAST(l_partkey % 25 AS VARCHAR) AS workspace_id, CAST(l_partkey AS VARCHAR) AS sku,
                   'line ' || l_orderkey AS name, l_linestatus AS category,
                   CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_quantity AS INT) AS qty,
                   CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END AS expires_on,
                   CAST(l_shipdate AS DATE) AS created_at,
                   row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC,
                     l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS n
            FROM lineitem WHERE l_returnflag <> 'N') WHERE n = 1) s
          ON s.workspace_id = t.workspace_id AND s.sku = t.sku""",
    "samples": """
        SELECT workspace_id, import_type, 3 - n AS o, fields,
               count(*) OVER (PARTITION BY workspace_id, import_type) AS c
        FROM (
          SELECT workspace_id, 'sales' AS import_type, concat_ws('|', CAST(date AS VARCHAR), sku, name, category,
                   quantity, amount_inr, coalesce(CAST(margin_pct AS VARCHAR), '')) AS fields,
                 row_number() OVER (PARTITION BY workspace_id ORDER BY date DESC, created_at DESC, id DESC) AS n
          FROM sales
          UNION ALL
          SELECT workspace_id, 'purchases', concat_ws('|', CAST(date AS VARCHAR), supplier_name, sku, quantity, amount_inr),
                 row_number() OVER (PARTITION BY workspace_id ORDER BY date DESC, created_at DESC, id DESC)
          FROM purchases
          UNION ALL
          SELECT workspace_id, 'products', concat_ws('|', sku, name, category, unit_price_inr, quantity_on_hand,
                   coalesce(CAST(expires_on AS VARCHAR), '')),
                 row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, sku DESC)
          FROM products
          UNION ALL
          SELECT workspace_id, 'expenses', concat_ws('|', CAST(occurred_on AS VARCHAR), label, category, amount_inr),
                 row_number() OVER (PARTITION BY workspace_id ORDER BY occurred_on DESC, created_at DESC, id DESC)
          FROM expenses
          UNION ALL
          SELECT workspace_id, 'recurring_obligations', concat_ws('|', label, category, amount_inr,
                   CAST(due_date AS VARCHAR), recurrence, status),
                 row_number() OVER (PARTITION BY workspace_id ORDER BY due_date DESC, created_at DESC, id DESC)
          FROM obligations) WHERE n <= 3""",
    "forecast_base": """
        SELECT ws.workspace_id, s AS sales, p AS purchases, e AS expenses, recurring_due AS recurring,
               s - p - e AS cash
        FROM (SELECT ws.workspace_id,
                     coalesce(max(CASE WHEN import_type = 'sales' THEN average END), 0) AS s,
                     coalesce(max(CASE WHEN import_type = 'purchases' THEN average END), 0) AS p,
                     coalesce(max(CASE WHEN import_type = 'expenses' THEN average END), 0) AS e
              FROM ws LEFT JOIN averages a ON a.workspace_id = ws.workspace_id GROUP BY 1) ws
        JOIN facts f ON f.workspace_id = ws.workspace_id""",
    "due_lines": f"""
        SELECT workspace_id, 'due_today' AS section,
               status_rank || '|' || CAST(due_date AS VARCHAR) || '|' || label || '|' || id AS sort_key,
               label || ' — ' || {{full:amount_inr}} AS text
        FROM unpaid WHERE due_date <= {AS_OF}""",
}

_SPACES = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _short(x: str) -> str:
    """Amount text, rounding half up on decimals as the Spark formatter does."""
    return (
        f"(CASE WHEN {x} >= 100000 THEN '₹' || CAST(CAST(round(CAST({x} / 100000 AS DECIMAL(30,10)), 2) AS DECIMAL(30,2)) AS VARCHAR) || 'L' "
        f"WHEN {x} >= 1000 THEN '₹' || CAST(CAST(round(CAST({x} / 1000 AS DECIMAL(30,10)), 1) AS DECIMAL(30,1)) AS VARCHAR) || 'K' "
        f"ELSE {_full(x)} END)"
    )


def _grouped(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT))"


def _full(x: str) -> str:
    return f"('₹' || {_grouped(x)})"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACES}+', ' ', 'g'))"


def _vectors(source: str, keys: str, column: str) -> str:
    """Hashed, signed token weights per slot as a list of 24, unit length, six places."""
    return f"""
        SELECT {keys}, list_transform(range(0, 24), lambda s: CASE WHEN norm > 0
                 THEN round(coalesce(list_sum(list_transform(list_filter(toks, lambda t: t.slot = s), lambda t: t.w)), 0) / norm, 6)
                 ELSE 0.0::DOUBLE END) AS v
        FROM (SELECT {keys}, toks, sqrt(CAST(list_sum(list_transform(range(0, 24), lambda s: pow(coalesce(
                 list_sum(list_transform(list_filter(toks, lambda t: t.slot = s), lambda t: t.w)), 0), 2))) AS DOUBLE)) AS norm
          FROM (SELECT {keys}, list_transform(list_transform(list_filter(regexp_split_to_array(lower({column}), '{_SPACES}+'),
                   lambda t: t <> ''), lambda t: sha256(t)), lambda d: {{
                     'slot': CAST('0x' || substr(d, 1, 8) AS BIGINT) % 24,
                     'w': CAST((CASE WHEN CAST('0x' || substr(d, 9, 2) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END)
                          * (250 + CAST('0x' || substr(d, 11, 4) AS BIGINT) % 1000) AS DOUBLE)}}) AS toks
                FROM {source}))"""


def _decimals(places: int):
    """Rounding half up of the shortest decimal text of a double, as Spark rounds it."""
    return (
        lambda x: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {places}) AS DOUBLE)"
    )


def _fill(sql: str) -> str:
    sql = re.sub(
        r"\{vectors:(\w+):([^:}]+):(\w+)\}", lambda m: _vectors(m[1], m[2], m[3]), sql
    )
    for name, make in [
        ("short", _short), ("full", _full), ("grouped", _grouped), ("squeeze", _squeeze),
        ("dec2", _decimals(2)), ("dec4", _decimals(4)), ("dec6", _decimals(6)),
    ]:
        sql = re.sub(rf"\{{{name}:([^{{}}]+)\}}", lambda m, make=make: make(m[1]), sql)
    return sql


def _needed(sql: str, seen: dict[str, None]) -> dict[str, None]:
    for name, body in CTES.items():
        used = re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) or f"vectors:{name}:" in sql
        if used and name not in seen:
            _needed(body, seen)
            seen[name] = None
    return seen


def sql(body: str) -> str:
    """A query with the views it names, as common table expressions."""
    names = _needed(body, {})
    ctes = ",\n".join(f"{n} AS ({_fill(CTES[n])})" for n in names)
    body = _fill(body)
    own = re.match(r"\s*WITH RECURSIVE ", body)
    if own:  # a query with a recursion of its own goes on with the list of views
        return f"WITH RECURSIVE {ctes},\n{body[own.end():]}"
    return (f"WITH {ctes}\n" if ctes else "") + body


def _melt(kind: str, fields: list[str]) -> str:
    pairs = ", ".join(f"{{'f': '{f}', 'v': {f}}}" for f in fields)
    return f"""SELECT workspace_id, job_id, row_index, u.f AS field, u.v AS value
        FROM (SELECT workspace_id, job_id, row_index, unnest([{pairs}]) AS u
              FROM typed WHERE import_type = '{kind}')"""


_STAMPS = """strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
    strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"""

_ACTION_STATUS = """CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'signup' THEN 'snoozed'
    WHEN 'view' THEN 'open' ELSE 'watching' END"""

_ACTIONS_AFTER = f"""
    SELECT coalesce(a.workspace_id, c.workspace_id) AS workspace_id, coalesce(a.id, c.entity_id) AS id,
           coalesce(title, 'Manual action entry') AS title,
           coalesce(detail, 'Action was manually added during status update.') AS detail,
           coalesce(severity, 'info') AS severity, coalesce(action_type, 'manual_review') AS action_type,
           coalesce(target_entity, 'Manual action') AS target_entity,
           CASE WHEN c.entity_id IS NULL THEN a.status ELSE c.status END AS status,
           CASE WHEN c.entity_id IS NULL THEN a.snoozed_until
                WHEN c.status = 'snoozed' THEN CAST(CAST(c.ts AS DATE) + 3 AS VARCHAR) END AS snoozed_until,
           CASE WHEN c.entity_id IS NULL THEN a.resolution_note
                WHEN c.status = 'resolved' THEN 'note-' || c.change_id END AS resolution_note,
           strftime(CASE WHEN a.id IS NULL THEN c.ts ELSE a.created_at END, '%Y-%m-%d %H:%M:%S') AS created_at,
           strftime(CASE WHEN c.entity_id IS NULL THEN a.updated_at ELSE c.ts END, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM stored_actions a FULL JOIN (
      SELECT workspace_id, entity_id, {_ACTION_STATUS} AS status, ts, change_id FROM (
        SELECT *, row_number() OVER (PARTITION BY workspace_id, entity_id ORDER BY ts DESC, change_id DESC) AS n
        FROM action_changes) WHERE n = 1) c
      ON a.workspace_id = c.workspace_id AND a.id = c.entity_id"""

_OBLIGATIONS_AFTER = """
    SELECT o.workspace_id, o.id, CASE c.event_type WHEN 'purchase' THEN 'paid' WHEN 'view' THEN 'due'
             ELSE CASE WHEN c.entity_id IS NULL THEN o.status ELSE 'scheduled' END END AS status
    FROM obligations o LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, entity_id
          ORDER BY ts DESC, change_id DESC) AS n FROM obligation_changes) WHERE n = 1) c
      ON o.workspace_id = c.workspace_id AND o.id = c.entity_id"""


# the candidates after the bills of some workspaces have changed: the same views over other bills
CTES["later_obligations"] = f"""
    SELECT o.* REPLACE (a.status AS status,
             CASE a.status WHEN 'paid' THEN 2 WHEN 'due' THEN 0 ELSE 1 END AS status_rank)
    FROM obligations o JOIN ({_OBLIGATIONS_AFTER}) a ON a.workspace_id = o.workspace_id AND a.id = o.id
    WHERE CAST(o.workspace_id AS INT) % 3 = 0"""
for _name, _from in {
    "unpaid": "obligations",
    "soonest": "unpaid",
    "bill_candidates": "soonest",
    "found_candidates": "bill_candidates",
    "candidates": "found_candidates",
}.items():
    CTES[f"later_{_name}"] = re.sub(rf"\b(FROM|JOIN) {_from}\b", rf"\1 later_{_from}", CTES[_name])

_CHAINS = """
    WITH RECURSIVE seq AS (
      SELECT c.*, row_number() OVER (PARTITION BY c.workspace_id ORDER BY change_id) AS n, m.user_id AS member
      FROM role_chains c LEFT JOIN members m ON m.workspace_id = c.workspace_id AND m.user_id = c.user_id),
    run AS (
      SELECT workspace_id, CAST(0 AS BIGINT) AS n, coalesce(list(user_id) FILTER (role = 'owner'), []) AS owners,
             CAST(NULL AS BIGINT) AS change_id, CAST('' AS VARCHAR) AS outcome
      FROM members GROUP BY 1
      UNION ALL
      SELECT r.workspace_id, s.n,
             CASE WHEN s.outcome <> 'applied' THEN r.owners
                  WHEN s.role = 'owner' THEN list_distinct(list_append(r.owners, s.user_id))
                  ELSE list_filter(r.owners, lambda x: x <> s.user_id) END,
             s.change_id, s.outcome
      FROM run r JOIN LATERAL (
        SELECT q.*, CASE WHEN NOT list_contains(r.owners, q.requester_id) THEN 'not_owner'
                         WHEN q.role NOT IN ('owner', 'manager', 'accountant') THEN 'invalid_role'
                         WHEN q.requester_id = q.user_id AND q.role <> 'owner' THEN 'self_demotion'
                         WHEN q.member IS NULL THEN 'member_not_found' ELSE 'applied' END AS outcome
        FROM seq q WHERE q.workspace_id = r.workspace_id AND q.n = r.n + 1) s ON true)"""

def _mask(key: str, x: str, keep_numbers: bool = False) -> str:
    t = f"regexp_replace({x}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"
    alias = f"'{key}-' || upper(substr(sha1({t}), 1, 8))"
    email = f"'email-' || substr(sha1({t}), 1, 8) || '@example.com'"
    is_email = "true" if key == "email" else f"regexp_matches({t}, '^[^@]+@[^@]+[.][^@]+$')"
    is_phone = "true" if key == "mobile" else f"regexp_matches({t}, '\\p{{Nd}}{{7,}}')"
    if keep_numbers:
        is_phone += f" AND NOT regexp_matches({t}, '^[+-]?\\p{{Nd}}+([.]\\p{{Nd}}+)?$')"
    rest = alias if key in ("address", "name", "owner", "supplier", "title") else x
    return f"""CASE WHEN {t} = '' THEN {x} WHEN {is_email} THEN {email}
        WHEN {is_phone} THEN '+91-XXXX-XXXX' ELSE {rest} END"""


_RAW_NUMBER = """CASE event_id % 6
    WHEN 0 THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)
    WHEN 1 THEN '  ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || ' '
    WHEN 2 THEN CAST(CAST(floor(value) AS INT) AS VARCHAR) || 'd' WHEN 3 THEN 'nan'
    WHEN 4 THEN '-' || CAST(CAST(floor(value) AS INT) AS VARCHAR) || 'e1' ELSE '' END"""

_PERCENT = "printf('%.1f', CAST(round(CAST(percentage AS DECIMAL(12,2)), 1) AS DOUBLE))"

_SCENARIOS = f"""
    SELECT CAST(user_id % 25 AS VARCHAR) AS workspace_id, CAST(event_id AS VARCHAR) AS request_id,
           CASE event_type WHEN 'click' THEN 'supplier_price_increase'
                WHEN 'purchase' THEN 'underperforming_product_line' WHEN 'view' THEN 'delayed_reorder'
                WHEN 'signup' THEN 'rent_electricity_increase' ELSE 'flood' END AS scenario_type,
           CAST(floor(value) AS INT) AS horizon_days, value AS percentage
    FROM events WHERE floor(value) BETWEEN 7 AND 180 AND value BETWEEN 0 AND 100"""

_RISKS = (
    "Recurring supplier and utility costs can compress short-term cash."
    "|Near-expiry inventory can force discounting and reduce realized margin."
)
_ADVICE = (
    "Prioritize near-expiry SKUs in the next local promotion cycle."
    "|Delay low-priority reorders until after high-value supplier dues are cleared."
    "|Review expense categories weekly using the guarded SQL assistant prompts."
)
_ELEVATED = (
    "Profit pressure is elevated because margin is slipping below 22% while recurring supplier "
    "and utility costs remain high."
)
_STEADY = (
    "Profit pressure is mainly from rising operating costs and near-term supplier cash obligations "
    "while tracked revenue is %s."
)
_REFUSED = "Only safe, read-only business analytics prompts are supported."
_REFUSED_ADVICE = "Ask business questions such as 'why did profit drop?' or 'top selling SKUs this month'."


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUERIES = {
    "a1_csv_uploads": """
        SELECT 'expenses-' || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS layout,
               CAST(DATE '2026-01-01' + CAST(c_custkey % 100 AS INT) AS VARCHAR) AS occurred_on,
               c_name || ' "' || c_mktsegment || '",' || chr(10) || 'line two' AS label,
               c_mktsegment AS category, CAST(c_custkey * 3 AS DOUBLE) AS amount_inr, '' AS reasons
        FROM customer""",
    "a1_mixed_layouts": """
        SELECT headers, date, sku, name, amount_inr,
               2 + CAST(name IS NOT NULL AS BIGINT) + CAST(amount_inr IS NOT NULL AS BIGINT) AS fields
        FROM (
          SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, printf('%05d', o_custkey) AS sku,
                 CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ', "' || o_orderstatus || '"' END AS name,
                 CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey * 2 AS VARCHAR) END
                      WHEN o_orderkey % 10 = 4
                        THEN coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey * 2 AS VARCHAR) END,
                                      CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END)
                      ELSE coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END,
                                    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey * 2 AS VARCHAR) END)
                 END AS amount_inr,
                 CASE o_orderkey % 10
                   WHEN 0 THEN 'Date|SKU|Product Name|revenue_inr|Revenue INR'
                   WHEN 1 THEN 'sku|note, own|revenue_inr|_memo 1|DATE'
                   WHEN 2 THEN 'Product Name|revenue_inr|Revenue INR|Date|SKU'
                   WHEN 3 THEN 'revenue_inr|_memo 3|DATE|sku|note, own'
                   WHEN 4 THEN 'Revenue INR|Date|SKU|Product Name|revenue_inr'
                   WHEN 5 THEN 'DATE|sku|note, own|revenue_inr|_memo 5'
                   WHEN 6 THEN 'SKU|Product Name|revenue_inr|Revenue INR|Date'
                   WHEN 7 THEN 'note, own|revenue_inr|_memo 7|DATE|sku'
                   WHEN 8 THEN 'revenue_inr|Revenue INR|Date|SKU|Product Name'
                   ELSE '_memo 9|DATE|sku|note, own|revenue_inr' END AS headers
          FROM orders)""",
    "a2_document_json": """
        SELECT source || '-' || doc_id AS title, lang AS kind, text AS summary,
               CAST(DATE '2026-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) AS uploaded_at
        FROM documents""",
    "a3_document_folder": """
        SELECT 'upload' AS kind, substr(content, 1, 280) AS summary, length(content) AS n_chars,
               sha256(content) AS content_sha256
        FROM (SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents
              GROUP BY source, doc_id // 200)""",
    "h7_file_chunks": r"""
        SELECT CAST(n - 1 AS INTEGER) AS chunk_index, parts[n] AS content
        FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM (
          SELECT list_filter(list_transform(regexp_extract_all({squeeze:content}, '(?s).{1,280}'),
                   lambda x: trim(x)), lambda x: x <> '') AS parts
          FROM (SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents
                GROUP BY source, doc_id // 200)))""",
    "a7_masked_csv": f'''
        SELECT CAST(c_custkey AS VARCHAR) AS sku, {_mask('supplier', 'c_name')} AS supplier,
               CASE WHEN c_custkey % 5 <> 0 THEN '+91-XXXX-XXXX' END AS phone,
               {_mask('notes', """('say "' || c_mktsegment || '", ' || c_mktsegment || '@x.example')""")} AS notes
        FROM customer''',
    "a7_masked_json": f"""
        SELECT doc_id, {_mask('title', 'source')} AS title, {_mask('summary', 'text')} AS summary FROM documents""",
    "b14_masked_nested": f"""
        SELECT o_orderkey,
               {_mask('owner', 'o_orderpriority')} AS owner_first,
               {_mask('email', 'o_orderstatus')} AS info_email, CAST(o_custkey AS INTEGER) AS info_qty,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '+91-XXXX-XXXX' END AS cell_phone,
               {_mask('name', 'o_orderpriority')} AS cell_name, o_orderstatus AS cell_memo
        FROM orders""",
    "a4_staged_rows": """
        SELECT workspace_id, job_id, import_type, filename, count(*) AS row_count, 'pending' AS status,
               count(r.row_index) AS staged, max(r.row_index) AS last_index
        FROM upload_lines u LEFT JOIN rows_kept r USING (job_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)
        GROUP BY ALL""",
    "a4_staged_payloads": "SELECT workspace_id, job_id, row_index, target AS field, value FROM staged",
    "a5_fact_append": """
        SELECT workspace_id, category, count(*) AS row_count, CAST(sum(amount_inr) AS DOUBLE) AS amount_inr
        FROM sales GROUP BY ALL""",
    "a5_confirmed_ledgers": """
        SELECT t.workspace_id, t.import_type, count(*) AS row_count, CAST(sum(CAST(amount AS DECIMAL(12,2))) AS DOUBLE) AS amount_inr
        FROM (
          SELECT workspace_id, job_id, import_type, amount_inr AS amount FROM typed
          WHERE import_type NOT IN ('products', 'inventory')
          UNION ALL
          SELECT workspace_id, any_value(job_id), 'products', max_by(unit_price_inr, {'a': job_id, 'b': row_index})
          FROM typed WHERE import_type = 'products' AND job_id IN (SELECT job_id FROM jobs WHERE status = 'pending')
          GROUP BY workspace_id, sku) t
        JOIN jobs j ON j.job_id = t.job_id WHERE j.status = 'pending' GROUP BY ALL""",
    "h15_json_payloads": """
        SELECT job_id, l_linenumber, l_partkey, l_suppkey, s.target AS field, s.value
        FROM staged s JOIN rows_kept r USING (job_id, row_index)""",
    "a6_versioned_products": "SELECT * FROM merged_products",
    "a8_adhoc_sql": """
        SELECT s.workspace_id, revenue, expense
        FROM (SELECT workspace_id, CAST(sum(amount_inr) AS DOUBLE) AS revenue FROM sales GROUP BY 1) s
        JOIN (SELECT workspace_id, CAST(sum(amount_inr) AS DOUBLE) AS expense FROM expenses GROUP BY 1) e
          ON s.workspace_id = e.workspace_id""",
    "b1_header_mapping": """
        SELECT DISTINCT workspace_id, job_id, import_type, header, pos AS position, target FROM mapped""",
    "b2_normalised_rows": "SELECT job_id, row_index, target AS field, value FROM staged",
    "b3_import_preview": """
        SELECT m.workspace_id, m.job_id, m.import_type, m.filename, max(n.row_count) AS row_count,
               string_agg(header, '|' ORDER BY pos) AS columns,
               concat_ws('|',
                 'Some columns need manual review: ' || string_agg(header, ', ' ORDER BY header)
                   FILTER (target = 'review_manually'),
                 max(CASE m.import_type WHEN 'products' THEN 'Missing canonical mappings: category' END)) AS warnings
        FROM (SELECT DISTINCT workspace_id, job_id, import_type, filename, header, pos, target FROM mapped) m
        JOIN (SELECT job_id, count(*) AS row_count FROM upload_lines GROUP BY 1) n USING (job_id)
        GROUP BY ALL""",
    "b4_coerced_sales": _melt(
        "sales", ["date", "sku", "name", "category", "quantity", "amount_inr", "margin_pct"]
    ),
    "b4_coerced_purchases": _melt(
        "purchases", ["date", "supplier_name", "sku", "quantity", "amount_inr"]
    ),
    "b4_coerced_products": _melt(
        "products",
        ["sku", "name", "category", "unit_price_inr", "quantity_on_hand", "expires_on"],
    ),
    "b4_coerced_expenses": _melt(
        "expenses", ["occurred_on", "label", "category", "amount_inr"]
    ),
    "b4_coerced_obligations": _melt(
        "recurring_obligations",
        ["label", "category", "amount_inr", "due_date", "recurrence", "status"],
    ),
    "b5_validated_entries": """
        SELECT id, concat_ws('|', CASE WHEN quantity - 3 < 1 THEN 'quantity_below_1' END,
                 CASE WHEN amount_inr - 5000 < 0 THEN 'negative_amount' END,
                 CASE WHEN margin_pct * 8 NOT BETWEEN 0 AND 100 THEN 'margin_out_of_range' END) AS reasons
        FROM sales""",
    "b6_normalised_enums": """
        SELECT event_id, CASE event_type WHEN 'purchase' THEN 'paid' ELSE 'scheduled' END AS obligation_status,
               CASE event_type WHEN 'view' THEN 'annual' ELSE 'monthly' END AS recurrence,
               CASE event_type WHEN 'click' THEN 'hybrid' ELSE 'local-open' END AS mode,
               CASE event_type WHEN 'signup' THEN 'snoozed' ELSE 'watching' END AS action_status
        FROM events""",
    "b7_tenant_totals": """
        SELECT workspace_id, count(*) AS row_count, CAST(sum(amount_inr) AS DOUBLE) AS amount_inr
        FROM purchases GROUP BY 1""",
    "b7_one_tenant": """
        SELECT workspace_id, supplier_name, count(*) AS row_count, CAST(sum(amount_inr) AS DOUBLE) AS amount_inr
        FROM purchases WHERE workspace_id = '7' GROUP BY 1, 2""",
    "b4_manual_obligations": """
        SELECT CAST(o_custkey % 25 AS VARCHAR) AS workspace_id, CAST(o_orderkey AS VARCHAR) AS request_id,
               o_orderpriority AS label, o_orderstatus AS category,
               CAST(round(CAST(CAST(o_totalprice / 8 AS VARCHAR) AS DECIMAL(38,12)), 2) AS DOUBLE) AS amount_inr,
               CASE WHEN o_orderkey % 2 = 0 THEN 'annual' ELSE 'monthly' END AS recurrence,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'scheduled' ELSE 'due' END AS status
        FROM orders""",
    "h4_even_quantities": """
        SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS half FROM lineitem""",
    "b14_masked_json": f"""
        SELECT o_orderkey, CASE o_orderkey % 3
          WHEN 0 THEN '{{"id":' || o_orderkey || ',"info":{{"email":"' || {_mask('email', 'o_orderstatus')} || '","qty":'
            || o_orderkey || '}},"owner":["' || {_mask('owner', 'o_orderpriority')} || '"," "]}}'
          WHEN 1 THEN '{{"contacts":[{{"name":"' || {_mask('name', 'o_orderpriority')}
            || '","phone":"+91-XXXX-XXXX"}},{{"mobile":"+91-XXXX-XXXX"}}],"id":' || o_orderkey || ',"memo":"'
            || o_orderstatus || '"}}'
          ELSE '{{"id":' || o_orderkey || ',"notes":["+91-XXXX-XXXX","email-' || substr(sha1('b@c.de'), 1, 8)
            || '@example.com",1234567,null,true],"title":{{"sub":"' || o_orderpriority || '"}}}}' END AS masked
        FROM orders""",
    "b8_due_window": """
        SELECT workspace_id, id, CAST(due_date AS VARCHAR) AS due_date, CAST(amount_inr AS DOUBLE) AS amount_inr
        FROM due_soon""",
    "b8_due_today": f"""
        SELECT workspace_id, id, CAST(due_date AS VARCHAR) AS due_date, CAST(amount_inr AS DOUBLE) AS amount_inr
        FROM unpaid WHERE due_date <= {AS_OF}""",
    "b9_near_expiry": """
        SELECT workspace_id, sku, CAST(expires_on AS VARCHAR) AS expires_on FROM expiring""",
    "b10_guarded_questions": """
        SELECT question_id, refused, contains(q, ';') OR contains(q, '--') OR regexp_matches(q,
                 '^\\s*(drop|delete|truncate|alter|grant|revoke)\\s') AS refused_statement
        FROM classified""",
    "b11_task_classes": "SELECT question_id, task FROM classified",
    "b12_routed_insights": """
        SELECT question_id, route, CASE route WHEN 'top_products' THEN top_products ELSE top_expenses END AS insight
        FROM classified JOIN insights USING (workspace_id) WHERE route IS NOT NULL""",
    "b13_masked_documents": f"""
        SELECT doc_id, {_mask('notes', 'text')} AS notes, {_mask('notes', 'text', True)} AS notes_kept_numbers,
               {_mask('title', "(source || '-' || doc_id)")} AS title, {_mask('source', 'source')} AS source
        FROM documents""",
    "b13_masked_customers": f"""
        SELECT c_custkey, {_mask('name', 'c_mktsegment')} AS name, {_mask('supplier', 'c_name')} AS supplier,
               {_mask('mobile', 'CAST(c_custkey AS VARCHAR)')} AS mobile,
               {_mask('address', "(' ' || c_mktsegment)")} AS address, {_mask('email', 'c_name')} AS email,
               {_mask('contact', "(c_mktsegment || '@shop.example')")} AS contact,
               {_mask('sku', "('12345' || c_custkey)")} AS sku
        FROM customer""",
    "c1_chunk_titles": """
        SELECT c.workspace_id, c.document_id, chunk_index, content, title
        FROM chunks c JOIN docs d ON c.document_id = d.document_id""",
    "c2_load_sales": """
        SELECT workspace_id, CAST(date AS VARCHAR) AS date, sku, CAST(amount_inr AS DOUBLE) AS amount_inr, min(id) AS id
        FROM sales GROUP BY ALL HAVING count(*) FILTER (l_linestatus = 'F') = 0""",
    "c2_load_purchases": """
        SELECT workspace_id, CAST(date AS VARCHAR) AS date, sku, min_by(supplier_name, id) AS supplier_name,
               CAST(amount_inr AS DOUBLE) AS amount_inr, min(id) AS id
        FROM purchases WHERE amount_inr <= 250 GROUP BY workspace_id, date, sku, amount_inr""",
    "c2_load_expenses": """
        SELECT workspace_id, CAST(occurred_on AS VARCHAR) AS occurred_on, label,
               CAST(amount_inr AS DOUBLE) AS amount_inr, min_by(id, {'a': created_at, 'b': id}) AS id
        FROM expenses GROUP BY workspace_id, occurred_on, label, amount_inr
        HAVING count(*) FILTER (category = 'Utilities') = 0""",
    "c2_load_obligations": """
        SELECT workspace_id, CAST(due_date AS VARCHAR) AS due_date, split_part(label, '-', 1) AS label, min(id) AS id
        FROM obligations GROUP BY workspace_id, due_date, split_part(label, '-', 1)
        HAVING count(*) FILTER (status = 'paid') = 0""",
    "c3_upserted_products": "SELECT * FROM merged_products",
    "c4_upserted_documents": """
        SELECT d.workspace_id, d.document_id, d.title, CASE WHEN kind = 'en' THEN 'update' ELSE kind END AS kind,
               CASE WHEN len(parts) > 0 THEN len(parts) END AS chunk_count,
               CAST(list_sum(list_transform(parts, lambda x: length(x))) AS BIGINT) AS chars, parts[1] AS first_chunk
        FROM docs d JOIN (
          SELECT document_id, list_filter(list_transform(regexp_extract_all({squeeze:t}, '(?s).{1,280}'),
                   lambda x: trim(x)), lambda x: x <> '') AS parts
          FROM (SELECT document_id, CASE WHEN kind = 'en' THEN 'again ' || summary ELSE summary END AS t FROM docs)) p
          ON d.document_id = p.document_id""",
    "c5_upserted_settings": """
        SELECT CAST(c_custkey AS VARCHAR) AS workspace_id,
               CASE WHEN e.event_type IS NULL
                    THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'hybrid' WHEN 'FURNITURE' THEN 'byo-cloud' ELSE 'local-open' END
                    ELSE CASE e.event_type WHEN 'click' THEN 'hybrid' WHEN 'view' THEN 'byo-cloud' ELSE 'local-open' END END AS mode,
               CASE WHEN e.event_type IS NULL THEN lower(c_mktsegment) || '|local' ELSE e.event_type || '|ollama' END AS providers
        FROM customer LEFT JOIN (SELECT user_id, max_by(event_type, ts) AS event_type FROM events GROUP BY 1) e
          ON user_id = c_custkey""",
    "c5_settings_defaults": """
        SELECT CAST(c_custkey AS VARCHAR) AS workspace_id,
               CASE e.event_type WHEN 'click' THEN 'hybrid' WHEN 'view' THEN 'byo-cloud' ELSE 'local-open' END AS mode,
               coalesce(e.event_type || '|ollama', '') AS providers
        FROM customer LEFT JOIN (SELECT user_id, max_by(event_type, ts) AS event_type FROM events GROUP BY 1) e
          ON user_id = c_custkey""",
    "c6_synced_actions": f"SELECT * REPLACE ({_STAMPS}) FROM queue",
    "c6_refreshed_actions": f"""
        SELECT * REPLACE ({_STAMPS}) FROM (
          SELECT coalesce(s.workspace_id, c.workspace_id) AS workspace_id, coalesce(s.id, c.id) AS id,
                 coalesce(c.title, s.title) AS title, coalesce(c.detail, s.detail) AS detail,
                 coalesce(c.severity, s.severity) AS severity,
                 coalesce(c.action_type, s.action_type) AS action_type,
                 coalesce(c.target_entity, s.target_entity) AS target_entity,
                 coalesce(s.status, c.status) AS status, s.snoozed_until, s.resolution_note,
                 CASE WHEN s.id IS NULL THEN TIMESTAMP '1998-06-15 13:00:00' ELSE s.created_at END AS created_at,
                 CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '1998-06-15 13:00:00' ELSE s.updated_at END AS updated_at
          FROM (SELECT * FROM queue WHERE workspace_id IN (
                  SELECT workspace_id FROM obligation_changes WHERE CAST(workspace_id AS INT) % 3 = 0)) s
          FULL JOIN (SELECT * FROM later_candidates WHERE workspace_id IN (
                  SELECT workspace_id FROM obligation_changes WHERE CAST(workspace_id AS INT) % 3 = 0)) c
            ON s.workspace_id = c.workspace_id AND s.id = c.id
          WHERE NOT (c.id IS NULL AND s.status IN ('open', 'watching'))
          UNION ALL
          SELECT * FROM queue WHERE workspace_id NOT IN (
            SELECT workspace_id FROM obligation_changes WHERE CAST(workspace_id AS INT) % 3 = 0))""",
    "c7_latest_imports": """
        SELECT ws.workspace_id, k.import_type, CAST(max(confirmed_at) AS VARCHAR) AS latest_import_on
        FROM ws, (SELECT unnest(['sales', 'purchases', 'products', 'expenses', 'recurring_obligations']) AS import_type) k
        LEFT JOIN jobs j ON j.workspace_id = ws.workspace_id AND j.import_type = k.import_type AND j.status = 'confirmed'
        GROUP BY ALL""",
    "c8_visible_members": """
        SELECT workspace_id, user_id, CASE role WHEN 'guest' THEN 'accountant' ELSE role END AS role,
               CAST(created_at AS VARCHAR) AS since
        FROM members WHERE workspace_id IN (
          SELECT workspace_id FROM members JOIN (
            SELECT CAST(max_by(c_custkey, {'a': c_acctbal, 'b': c_custkey}) AS VARCHAR) AS requester FROM customer GROUP BY c_nationkey)
            ON requester = user_id WHERE role IN ('owner', 'manager'))""",
    "c8_viewing_rights": """
        SELECT CAST(a.at AS VARCHAR) AS workspace_id, a.requester_id, coalesce(m.role IN ('owner', 'manager'), false) AS allowed
        FROM (SELECT unnest([c_nationkey, (c_nationkey + 1) % 25]) AS at, CAST(c_custkey AS VARCHAR) AS requester_id
              FROM customer) a
        LEFT JOIN members m ON m.workspace_id = CAST(a.at AS VARCHAR) AND m.user_id = a.requester_id""",
    "c9_judged_role_changes": "SELECT * FROM judged",
    "c9_members_after_changes": """
        SELECT m.workspace_id, m.user_id, coalesce(j.role, m.role) AS role
        FROM members m LEFT JOIN (SELECT workspace_id, user_id, max_by(role, change_id) AS role
                                  FROM judged WHERE outcome = 'applied' GROUP BY ALL) j
          ON j.workspace_id = m.workspace_id AND j.user_id = m.user_id""",
    "c9_ordered_role_changes": _CHAINS + """
        SELECT c.*, r.outcome FROM role_chains c JOIN run r USING (workspace_id, change_id)""",
    "c9_members_after_ordered_changes": _CHAINS + """
        SELECT m.workspace_id, m.user_id, coalesce(j.role, m.role) AS role
        FROM members m LEFT JOIN (SELECT workspace_id, c.user_id, max_by(c.role, change_id) AS role
                                  FROM role_chains c JOIN run r USING (workspace_id, change_id)
                                  WHERE r.outcome = 'applied' GROUP BY ALL) j
          ON j.workspace_id = m.workspace_id AND j.user_id = m.user_id""",
    "c10_nearest_chunks": "SELECT * REPLACE (round(distance, 6) AS distance) FROM nearest WHERE ord <= 3",
    "c10_blocked_chunks": "SELECT * REPLACE (round(distance, 6) AS distance) FROM nearest WHERE ord <= 3",
    "c10_refreshed_index": "SELECT * REPLACE (round(distance, 6) AS distance) FROM nearest WHERE ord <= 3",
    "c10_citations": "SELECT * FROM cited",
    "c10_nearest_vectors": """
        SELECT * REPLACE (round(distance, 6) AS distance)
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, document_id) AS ord
          FROM (SELECT CAST(q.label AS VARCHAR) AS workspace_id, q.vec_id AS question_id, c.vec_id AS document_id,
                       round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) + 0.0 AS distance
                FROM embeddings q JOIN embeddings c ON q.label = c.label)) WHERE ord <= 3""",
    "c11_obligation_statuses": _OBLIGATIONS_AFTER,
    "c11_unknown_changes": """
        SELECT workspace_id, entity_id, 'bogus' AS status, max_by(change_id, {'a': ts, 'b': change_id}) AS change_id
        FROM obligation_changes WHERE entity_id LIKE 'unknown-%' GROUP BY ALL""",
    "c12_action_statuses": _ACTIONS_AFTER,
    "c13_confirmed_imports": """
        SELECT r.workspace_id, r.job_id,
               CASE WHEN j.job_id IS NULL THEN 'missing' WHEN j.status = 'confirmed' THEN 'already_confirmed'
                    ELSE 'confirmed' END AS outcome, j.import_type, coalesce(j.row_count, 0) AS row_count,
               CASE WHEN j.status = 'confirmed' THEN j.applied_count ELSE coalesce(s.n, 0) END AS applied_count,
               coalesce(a.names, '') AS affected_collections
        FROM requested r LEFT JOIN jobs j ON j.workspace_id = r.workspace_id AND j.job_id = r.job_id
        LEFT JOIN (SELECT job_id, count(*) AS n FROM rows_kept GROUP BY 1) s ON s.job_id = r.job_id
        LEFT JOIN affected a ON a.import_type = j.import_type""",
    "c13_jobs_after_confirm": """
        SELECT j.workspace_id, j.job_id, 'confirmed' AS status,
               CASE WHEN j.status = 'confirmed' THEN j.applied_count ELSE coalesce(s.n, 0) END AS applied_count,
               CASE WHEN j.status = 'confirmed' THEN CAST(confirmed_at AS VARCHAR) ELSE '1998-06-15' END AS confirmed_on
        FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM rows_kept GROUP BY 1) s ON s.job_id = j.job_id""",
    "c13_applied_rows": """
        SELECT t.workspace_id, t.job_id, t.row_index, t.import_type,
               CASE t.import_type WHEN 'products' THEN expires_on WHEN 'expenses' THEN occurred_on
                    WHEN 'recurring_obligations' THEN due_date ELSE date END AS day,
               CASE t.import_type WHEN 'sales' THEN sku WHEN 'purchases' THEN supplier_name
                    WHEN 'products' THEN name ELSE label END AS name,
               CAST(CASE t.import_type WHEN 'products' THEN unit_price_inr ELSE amount_inr END AS DOUBLE) AS amount
        FROM typed t JOIN jobs j ON j.job_id = t.job_id
        WHERE j.status = 'pending' AND t.import_type <> 'inventory'""",
    "d1_margin_series": """
        SELECT workspace_id, month(date) AS month_no, strftime(any_value(date), '%b') AS month_label,
               CAST(sum(amount_inr) AS DOUBLE) AS revenue_inr,
               {dec4:CAST(sum(margin_pct) AS DOUBLE) / count(margin_pct)} AS margin_pct
        FROM sales GROUP BY 1, 2""",
    "d1_margin_series_by_year": """
        SELECT workspace_id, year(date) AS year_no, month(date) AS month_no, strftime(any_value(date), '%b') AS month_label,
               CAST(sum(amount_inr) AS DOUBLE) AS revenue_inr,
               {dec4:CAST(sum(margin_pct) AS DOUBLE) / nullif(count(margin_pct), 0)} AS margin_pct
        FROM sales GROUP BY 1, 2, 3""",
    "d2_sales_totals": "SELECT workspace_id, total_revenue, {dec4:avg_margin} AS avg_margin FROM facts",
    "d3_bills_due": """
        SELECT workspace_id, total_due, coalesce(labels, 'No recurring bills due soon') AS labels FROM facts""",
    "d4_expiry_exposure": "SELECT workspace_id, lot_count, exposure FROM facts",
    "d5_utilities_mean": "SELECT workspace_id, {dec4:utility_avg} AS utility_avg FROM facts",
    "d6_top_supplier_due": "SELECT workspace_id, top_supplier_due FROM facts",
    "d7_recurring_due": "SELECT workspace_id, recurring_due FROM facts",
    "d7_kept_after_changes": f"""
        WITH RECURSIVE changed AS (
          SELECT o.workspace_id, o.id, o.label, o.category, o.amount_inr, o.due_date,
                 CASE WHEN CAST(o.workspace_id AS INT) % 3 = 0 THEN a.status ELSE o.status END AS status
          FROM obligations o JOIN ({_OBLIGATIONS_AFTER}) a ON a.workspace_id = o.workspace_id AND a.id = o.id),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY due_date,
                   CASE status WHEN 'due' THEN 0 WHEN 'scheduled' THEN 1 ELSE 2 END, label, id) AS n
          FROM changed WHERE status <> 'paid')
        SELECT ws.workspace_id, coalesce(CAST(sum(amount_inr) AS DOUBLE), 0) AS recurring_due,
               coalesce(CAST(max(amount_inr) FILTER (WHERE lower(category) = 'supplier') AS DOUBLE), 0)
                 AS top_supplier_due,
               max(id) FILTER (WHERE n = 1) AS soonest_id
        FROM ws LEFT JOIN ranked ON ranked.workspace_id = ws.workspace_id GROUP BY ws.workspace_id""",
    "d8_daily_totals": """
        SELECT workspace_id, import_type, CAST(day AS VARCHAR) AS day, CAST(daily_total AS DOUBLE) AS daily_total
        FROM daily""",
    "d9_revenue_per_sku": """
        SELECT workspace_id, sku, CAST(sum(amount_inr) AS DOUBLE) AS revenue FROM sales GROUP BY ALL""",
    "d10_expense_per_category": """
        SELECT workspace_id, category, CAST(sum(amount_inr) AS DOUBLE) AS expense_total FROM expenses GROUP BY ALL""",
    "d11_row_counts": """
        SELECT workspace_id, 'sales' AS import_type, count(*) AS row_count FROM sales GROUP BY ALL
        UNION ALL SELECT workspace_id, 'purchases', count(*) FROM purchases GROUP BY ALL
        UNION ALL SELECT workspace_id, 'products', count(*) FROM products GROUP BY ALL
        UNION ALL SELECT workspace_id, 'expenses', count(*) FROM expenses GROUP BY ALL
        UNION ALL SELECT workspace_id, 'recurring_obligations', count(*) FROM obligations GROUP BY ALL""",
    "d12_run_counts": f"""
        SELECT ws.workspace_id, 1 AS anomaly_count, greatest(1, count(u.id)) AS due_reminder_count
        FROM ws LEFT JOIN unpaid u ON u.workspace_id = ws.workspace_id AND u.due_date <= {AS_OF} GROUP BY 1""",
    "e1_moving_averages": """
        SELECT workspace_id, import_type, {dec4:average} AS average FROM averages""",
    "e1_live_moving_averages": """
        SELECT 'w' || workspace_id AS workspace_id, {dec4:average} AS average FROM averages WHERE import_type = 'expenses'""",
    "e1_moving_average_series": """
        SELECT workspace_id, CAST(day AS VARCHAR) AS day, CAST(daily_total AS DOUBLE) AS daily_total,
               {dec4:CAST(sum(daily_total) OVER w AS DOUBLE) / count(*) OVER w} AS average
        FROM daily WHERE import_type = 'sales'
        WINDOW w AS (PARTITION BY workspace_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "e2_latest_rows": """
        SELECT workspace_id, import_type, CAST(o - (3 - c) AS INT) AS ord, fields FROM samples""",
    "e3_soonest_due": """
        SELECT workspace_id, ord, id, days, CAST(amount_inr AS DOUBLE) AS amount_inr FROM soonest""",
    "f1_obligation_order": """
        SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY status_rank, due_date, label, id) - 1 AS position,
               id, status, CAST(due_date AS VARCHAR) AS due_date, label
        FROM obligations""",
    "f2_action_order": """
        SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY
                 CASE status WHEN 'open' THEN 0 WHEN 'watching' THEN 1 WHEN 'snoozed' THEN 2 ELSE 3 END,
                 updated_at DESC, id) - 1 AS position, id, status
        FROM stored_actions""",
    "f3_top_skus": "SELECT workspace_id, ord, sku, CAST(revenue AS DOUBLE) AS revenue FROM top_skus",
    "f4_top_categories": """
        SELECT workspace_id, ord, category, CAST(expense_total AS DOUBLE) AS expense_total FROM top_categories""",
    "f5_soonest_expiry": """
        SELECT workspace_id, sku, name, CAST(expires_on AS VARCHAR) AS expires_on, quantity_on_hand
        FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY expires_on, sku) AS n FROM expiring)
        WHERE n = 1""",
    "f6_documents_newest": """
        SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY uploaded_at DESC, document_id) - 1 AS position,
               document_id, CAST(uploaded_at AS VARCHAR) AS uploaded_at
        FROM docs""",
    "f7_import_history": """
        SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY confirmed_at DESC NULLS LAST,
                 created_at DESC, job_id) - 1 AS position, job_id, status
        FROM jobs""",
    "f8_member_order": """
        SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at, user_id) - 1 AS position, user_id
        FROM members""",
    "f9_queue_head": """
        SELECT workspace_id, n AS ord, id, title, status FROM queue_ranked WHERE n <= 4""",
    "g1_candidate_actions": "SELECT * FROM candidates",
    "g1_idle_workspaces": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS workspace_id, coalesce(s.id, 'watch-stock') AS id,
               coalesce(s.title, 'No urgent actions. Keep tracking slow-moving stock.') AS title,
               coalesce(s.detail, 'Your current obligations look stable. Use quick-add entries to keep decisions up to date.') AS detail,
               coalesce(s.severity, 'info') AS severity, coalesce(s.action_type, 'watchlist') AS action_type,
               coalesce(s.target_entity, 'Current workspace') AS target_entity, coalesce(s.status, 'watching') AS status
        FROM customer LEFT JOIN (
          SELECT o_custkey,
                 CASE WHEN category = 'Supplier' THEN 'draft-' ELSE 'obligation-' END || id AS id,
                 CASE WHEN category = 'Supplier' THEN 'Stage supplier follow-up for ' ELSE 'Protect cash for ' END || label AS title,
                 CASE WHEN category = 'Supplier'
                      THEN {{full:amount_inr}} || ' is due on ' || CAST(due_date AS VARCHAR)
                        || '. Prepare a message before the next payment cycle tightens cash.'
                      ELSE {{full:amount_inr}} || ' is ' || CASE WHEN days < 0 THEN 'overdue' ELSE 'due in ' || days || ' days' END
                        || ' and should stay visible in the owner plan.' END AS detail,
                 CASE WHEN days <= CASE WHEN category = 'Supplier' THEN 3 ELSE 2 END THEN 'critical' ELSE 'warning' END AS severity,
                 CASE WHEN category = 'Supplier' THEN 'vendor_follow_up' ELSE 'bill_review' END AS action_type,
                 label AS target_entity, 'open' AS status
          FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY days, due_date, label, id) AS n
                FROM (SELECT u.*, o_custkey FROM unpaid u JOIN orders ON id = CAST(o_orderkey AS VARCHAR)))
          WHERE n <= 3) s ON s.o_custkey = c_custkey""",
    "g2_inventory_alerts": "SELECT * FROM alerts",
    "h1_short_amounts": """
        SELECT o_orderkey, {short:x} AS short, {full:x} AS "full"
        FROM (SELECT o_orderkey, CAST(CAST(o_totalprice - 20000 AS DECIMAL(12,2)) AS DOUBLE) AS x FROM orders)""",
    "h3_parsed_numbers": f"""
        SELECT event_id,
               CASE WHEN event_id % 6 IN (0, 1, 4) THEN CAST(trim(raw) AS DOUBLE) ELSE 0 END AS as_double,
               CASE WHEN event_id % 6 IN (0, 1, 4) THEN CAST(trunc(CAST(trim(raw) AS DOUBLE)) AS INT) ELSE 1 END AS as_int,
               CASE WHEN event_id % 6 IN (0, 1, 4) THEN CAST(trim(raw) AS DOUBLE) ELSE 0 END AS as_money,
               CASE WHEN event_id % 6 = 2 THEN greatest(7, least(180, CAST(floor(value) AS INT))) ELSE 30 END AS as_horizon
        FROM (SELECT *, {_RAW_NUMBER} AS raw FROM events)""",
    "h7_document_chunks": "SELECT * FROM chunks",
    "h8_chunk_vectors": """
        SELECT * FROM (SELECT workspace_id, document_id, chunk_index, CAST(n AS INT) - 1 AS slot, v[n] AS x
          FROM (SELECT *, unnest(range(1, 25)) AS n FROM chunk_vectors)) WHERE x <> 0""",
    "h9_providers_and_costs": "SELECT question_id, mode, provider, cost AS cost_usd FROM priced",
    "k1_dashboard_stats": "SELECT * REPLACE ({dec4:number} AS number) FROM stats",
    "k2_margin_series": """
        SELECT workspace_id, month(date) AS month_no, strftime(any_value(date), '%b') AS label,
               round(CAST(sum(amount_inr) AS DOUBLE), 2) AS revenue_inr,
               {dec2:CAST(sum(margin_pct) AS DOUBLE) / count(margin_pct)} AS margin_pct
        FROM sales GROUP BY 1, 2""",
    "k3_inventory_alerts": "SELECT * FROM alerts",
    "k4_import_history": """
        SELECT workspace_id, job_id, import_type, filename, row_count, applied_count,
               CAST(confirmed_at AS VARCHAR) AS confirmed_on
        FROM jobs WHERE status = 'confirmed'""",
    "k4_collection_summaries": """
        SELECT ws.workspace_id, k.import_type, coalesce(n.row_count, 0) AS row_count,
               CAST(j.latest AS VARCHAR) AS latest_import_on, k.columns, coalesce(s.shown, '') AS sample_rows
        FROM ws, (VALUES ('sales', 'date|sku|name|category|quantity|amount_inr|margin_pct'),
            ('purchases', 'date|supplier_name|sku|quantity|amount_inr'),
            ('products', 'sku|name|category|unit_price_inr|quantity_on_hand|expires_on'),
            ('expenses', 'occurred_on|label|category|amount_inr'),
            ('recurring_obligations', 'label|category|amount_inr|due_date|recurrence|status')) k(import_type, columns)
        LEFT JOIN (
          SELECT workspace_id, 'sales' AS import_type, count(*) AS row_count FROM sales GROUP BY ALL
          UNION ALL SELECT workspace_id, 'purchases', count(*) FROM purchases GROUP BY ALL
          UNION ALL SELECT workspace_id, 'products', count(*) FROM products GROUP BY ALL
          UNION ALL SELECT workspace_id, 'expenses', count(*) FROM expenses GROUP BY ALL
          UNION ALL SELECT workspace_id, 'recurring_obligations', count(*) FROM obligations GROUP BY ALL) n
          ON n.workspace_id = ws.workspace_id AND n.import_type = k.import_type
        LEFT JOIN (SELECT workspace_id, import_type, max(confirmed_at) AS latest FROM jobs
                   WHERE status = 'confirmed' GROUP BY ALL) j
          ON j.workspace_id = ws.workspace_id AND j.import_type = k.import_type
        LEFT JOIN (SELECT workspace_id, import_type, string_agg(fields, '||' ORDER BY o) AS shown
                   FROM samples GROUP BY ALL) s
          ON s.workspace_id = ws.workspace_id AND s.import_type = k.import_type""",
    "k5_action_queue": f"SELECT * EXCLUDE (n) REPLACE ({_STAMPS}), n - 1 AS position FROM queue_ranked",
    "k6_action_drafts": """
        SELECT r.workspace_id, r.id AS request_id, 'obligation-' || r.id AS action_id, p.action_type, p.target_entity,
               CASE p.action_type
                 WHEN 'bill_review' THEN 'Recurring operating costs need a clear owner check before they land together.'
                 WHEN 'review_import' THEN 'Freshly imported records are only useful once the owner validates what changed.'
                 ELSE CASE p.status WHEN 'snoozed' THEN 'This action is snoozed and should be revalidated before execution.'
                   ELSE 'Short-term cash preservation is better than carrying more slow inventory.' END END AS rationale,
               CASE p.action_type
                 WHEN 'bill_review' THEN 'Review ' || p.target_entity || ' today, confirm the due amount, and decide whether it should be paid now, deferred, or offset by delaying a discretionary purchase.'
                 WHEN 'review_import' THEN 'Open the ' || replace(p.target_entity, '_', ' ') || ' ledger, verify the most recent rows, and use the updated history in the next margin or cash-flow investigation.'
                 ELSE CASE p.status WHEN 'snoozed' THEN 'Before acting on ' || p.target_entity || ', re-check whether the original trigger still applies and unsnooze if it is still operationally relevant.'
                   ELSE 'Hello, we would like to stagger the next settlement and trim the dermatology reorder size for this cycle while we move the current inventory first.' END END AS draft_text,
               p.action_type <> 'review_import' AS approval_required
        FROM (
          SELECT o.workspace_id, o.id, coalesce(a.action_type, b.action_type, 'review_import') AS action_type,
                 coalesce(a.target_entity, b.target_entity, 'Current workspace') AS target_entity,
                 coalesce(a.status, b.status, 'watching') AS status
          FROM obligations o
          LEFT JOIN queue a ON a.workspace_id = o.workspace_id AND a.id = 'obligation-' || o.id
          LEFT JOIN (SELECT workspace_id, min_by(action_type, n) AS action_type, min_by(target_entity, n) AS target_entity,
                            min_by(status, n) AS status FROM queue_ranked WHERE action_type = 'vendor_follow_up' GROUP BY 1) b
            ON b.workspace_id = o.workspace_id) p
        JOIN obligations r ON r.id = p.id""",
    "k7_owner_brief": """
        SELECT workspace_id, 'items' AS section, CAST(ord AS VARCHAR) AS sort_key,
               CASE ord WHEN 1 THEN 'Revenue snapshot: ' WHEN 2 THEN 'Gross margin snapshot: ' ELSE 'Bills due soon: ' END || value AS text
        FROM stats WHERE ord <= 3
        UNION ALL SELECT * FROM due_lines
        UNION ALL SELECT workspace_id, 'due_today', '', 'No recurring payments due today.' FROM ws
          WHERE workspace_id NOT IN (SELECT workspace_id FROM due_lines)
        UNION ALL SELECT workspace_id, 'anomalies', CAST(ord AS VARCHAR), title FROM alerts WHERE severity = 'warning'
        UNION ALL SELECT workspace_id, 'anomalies', '', 'No major anomalies detected in the current snapshot.' FROM ws
          WHERE workspace_id NOT IN (SELECT workspace_id FROM alerts WHERE severity = 'warning')
        UNION ALL SELECT workspace_id, 'suggested', CAST(n AS VARCHAR), title FROM queue_ranked WHERE n <= 2""",
    "k8_forecast": """
        SELECT workspace_id, request_id, metric, days || 'd' AS horizon, {dec4:base} AS base, {dec4:low} AS low,
               {dec4:high} AS high,
               CASE metric WHEN 'sales' THEN 'Recent daily sales moving average: '
                    WHEN 'purchases' THEN 'Recent daily purchase moving average: '
                    WHEN 'recurring' THEN 'Current unpaid recurring obligations: '
                    ELSE 'Current daily cash delta baseline: ' END || {short:base} AS baseline,
               {short:low} || ' to ' || {short:high} || CASE metric WHEN 'recurring'
                    THEN ' in next ' || days || ' days' ELSE ' per day' END AS projected_range,
               'Moving-average baseline over recent transactional history.|Light seasonality uplift for short-horizon pharmacy demand.|No abrupt structural shift in supplier availability.' AS assumptions,
               CASE metric WHEN 'sales' THEN 'Sales projection assumes similar OTC demand velocity.|Projection drops if near-expiry stock is not rotated faster.'
                    WHEN 'purchases' THEN 'Higher supplier dues may require staggered procurement.|Underperforming lines should not be reordered at baseline pace.'
                    WHEN 'recurring' THEN 'Utility and rent changes can widen this band quickly.|Treat supplier obligations as high-priority cash events.'
                    ELSE 'Cash projection assumes recurring dues are managed on time.|Delayed supplier payment can protect cash short term but raise reorder risk.' END AS warnings
        FROM (SELECT *, base * CASE metric WHEN 'sales' THEN 0.94::DOUBLE WHEN 'purchases' THEN 0.88::DOUBLE WHEN 'recurring' THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS low,
                     base * CASE metric WHEN 'sales' THEN CASE WHEN days <= 45 THEN 1.06::DOUBLE ELSE 1.03::DOUBLE END
                       WHEN 'purchases' THEN 1.08::DOUBLE WHEN 'recurring' THEN 1.1::DOUBLE ELSE 1.15::DOUBLE END AS high
              FROM (SELECT b.workspace_id, CAST(event_id AS VARCHAR) AS request_id,
                      CASE event_type WHEN 'purchase' THEN 'purchases' WHEN 'view' THEN 'recurring' WHEN 'signup' THEN 'cash' ELSE 'sales' END AS metric,
                      CASE WHEN event_type = 'error' THEN 30 ELSE greatest(7, least(180, CAST(floor(value) AS INT))) END AS days,
                      CASE event_type WHEN 'purchase' THEN purchases WHEN 'view' THEN recurring WHEN 'signup' THEN cash ELSE sales END AS base
                    FROM events JOIN forecast_base b ON b.workspace_id = CAST(user_id % 25 AS VARCHAR)))""",
    "k9_scenario_deltas": f"""
        SELECT r.workspace_id, request_id, o.ord, 
               CASE scenario_type || o.ord WHEN 'supplier_price_increase1' THEN 'Purchase cost'
                 WHEN 'supplier_price_increase2' THEN 'Cash runway' WHEN 'underperforming_product_line1' THEN 'Inventory carry'
                 WHEN 'underperforming_product_line2' THEN 'Margin realization' WHEN 'delayed_reorder1' THEN 'Short-term cash'
                 WHEN 'delayed_reorder2' THEN 'Stockout probability'
                 ELSE CASE o.ord WHEN 1 THEN 'Recurring overhead' ELSE 'Break-even threshold' END END AS metric,
               CASE scenario_type || o.ord WHEN 'supplier_price_increase1' THEN 'Recent daily sales moving average: ' || {{short:sales}}
                 WHEN 'supplier_price_increase2' THEN 'Current daily cash delta baseline: ' || {{short:cash}}
                 WHEN 'underperforming_product_line1' THEN 'Current carry aligned to recent demand'
                 WHEN 'underperforming_product_line2' THEN 'Current margin trajectory'
                 WHEN 'delayed_reorder1' THEN 'Current daily cash delta baseline: ' || {{short:cash}}
                 WHEN 'delayed_reorder2' THEN 'Current service level'
                 ELSE CASE o.ord WHEN 1 THEN 'Current recurring obligation baseline' ELSE 'Current daily break-even level' END END AS baseline,
               CASE scenario_type || o.ord WHEN 'supplier_price_increase1' THEN '+' || {_PERCENT} || '% relative cost pressure'
                 WHEN 'supplier_price_increase2' THEN 'Lower buffer due to procurement inflation.'
                 WHEN 'underperforming_product_line1' THEN 'Carry risk grows by roughly ' || {_PERCENT} || '%'
                 WHEN 'underperforming_product_line2' THEN 'Potential markdown-driven margin erosion.'
                 WHEN 'delayed_reorder1' THEN 'Improves by ~' || {_PERCENT} || '% temporarily'
                 WHEN 'delayed_reorder2' THEN 'Higher risk for fast-moving SKUs.'
                 ELSE CASE o.ord WHEN 1 THEN '+' || {_PERCENT} || '% fixed-cost burden' ELSE 'Higher required daily revenue.' END END AS projected,
               CASE scenario_type || o.ord WHEN 'supplier_price_increase1' THEN 'Gross margin compression risk increases.'
                 WHEN 'supplier_price_increase2' THEN 'Prioritize high-turn SKUs only.'
                 WHEN 'underperforming_product_line1' THEN 'Dead stock and expiry risk rises.'
                 WHEN 'underperforming_product_line2' THEN 'Profit conversion declines.'
                 WHEN 'delayed_reorder1' THEN 'Cash buffer improves in near term.'
                 WHEN 'delayed_reorder2' THEN 'Potential missed revenue days.'
                 ELSE CASE o.ord WHEN 1 THEN 'Lower net cash conversion.' ELSE 'More pressure on margin discipline.' END END AS impact
        FROM ({_SCENARIOS}) r JOIN forecast_base b ON b.workspace_id = r.workspace_id, (VALUES (1), (2)) o(ord)""",
    "k9_scenario_plans": f"""
        SELECT r.workspace_id, request_id, scenario_type, horizon_days,
               CASE scenario_type WHEN 'supplier_price_increase' THEN 'Supplier price increase scenario at +' || {_PERCENT} || '%.'
                 WHEN 'underperforming_product_line' THEN 'Underperforming line scenario with slower sell-through.'
                 WHEN 'delayed_reorder' THEN 'Delayed reorder scenario balancing cash protection and stockout risk.'
                 ELSE 'Rent/electricity increase scenario with fixed-cost pressure.' END AS summary,
               CASE scenario_type WHEN 'supplier_price_increase'
                 THEN 'Shift reorder budget toward high-turn and higher-margin SKUs.|Negotiate staggered payment terms on supplier dues.'
                 WHEN 'underperforming_product_line'
                 THEN 'Reduce reorder frequency for underperforming categories.|Run targeted movement campaigns for aging lots.'
                 WHEN 'delayed_reorder'
                 THEN 'Delay reorder only for low-turn SKUs.|Protect minimum stock thresholds for high-turn essentials.'
                 ELSE 'Review non-essential operating spend for offset opportunities.|Increase focus on better-margin product categories.' END AS recommendations
        FROM ({_SCENARIOS}) r JOIN ws ON ws.workspace_id = r.workspace_id""",
    "k10_investigations": f"""
        SELECT p.workspace_id, p.question_id, question, refused, CASE WHEN NOT refused THEN task END AS task,
               CASE WHEN refused THEN {_quoted("This request looks like a direct SQL control statement. " + _REFUSED)}
                    WHEN avg_margin < 22 THEN {_quoted(_ELEVATED)}
                    ELSE replace({_quoted(_STEADY)}, '%s', {{short:total_revenue}}) END AS summary,
               CASE WHEN refused THEN 0.98::DOUBLE ELSE least(0.96::DOUBLE, round(0.82::DOUBLE
                 + CASE WHEN c.n > 0 THEN 0.04::DOUBLE ELSE 0 END
                 + CASE WHEN route IS NOT NULL THEN 0.03::DOUBLE ELSE 0 END, 2)) END AS confidence,
               CASE WHEN refused THEN {_quoted("Unsafe query attempt blocked.")} ELSE {_quoted(_RISKS)} END AS risks,
               CASE WHEN refused THEN {_quoted(_REFUSED_ADVICE)} ELSE {_quoted(_ADVICE)} END AS recommendations,
               CASE WHEN refused THEN 'policy-guard' ELSE provider END AS provider,
               CASE WHEN refused THEN 'local-open' ELSE mode END AS mode,
               CASE WHEN refused THEN 0.0::DOUBLE ELSE cost END AS estimated_cost_usd
        FROM priced p JOIN facts f ON f.workspace_id = p.workspace_id
        LEFT JOIN (SELECT workspace_id, question_id, count(*) AS n FROM cited GROUP BY ALL) c
          ON c.workspace_id = p.workspace_id AND c.question_id = p.question_id""",
    "k10_evidence": f"""
        SELECT workspace_id, question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY o) AS INT) AS ord,
               label, detail, source
        FROM (
          SELECT workspace_id, question_id, 0 AS o, 'Guardrail policy' AS label,
                 {_quoted(_REFUSED)} AS detail, 'query_guardrails' AS source
          FROM classified WHERE refused
          UNION ALL
          SELECT c.workspace_id, question_id, 1, 'Utility pressure',
                 'Average utility burden is ₹' || {{grouped:utility_avg}} || ' this cycle.', 'expense_entries.utilities'
          FROM classified c JOIN facts f ON f.workspace_id = c.workspace_id WHERE NOT refused
          UNION ALL
          SELECT c.workspace_id, question_id, 2, 'Supplier cash pressure',
                 '₹' || {{grouped:top_supplier_due}} || ' is the largest upcoming supplier obligation.', 'recurring_obligations.supplier'
          FROM classified c JOIN facts f ON f.workspace_id = c.workspace_id WHERE NOT refused
          UNION ALL
          SELECT c.workspace_id, question_id, 3, 'Near-expiry risk',
                 lot_count || ' product lots are inside the next 45-day near-expiry window.', 'products.expiry_window_45d'
          FROM classified c JOIN facts f ON f.workspace_id = c.workspace_id WHERE NOT refused
          UNION ALL
          SELECT c.workspace_id, question_id, 4, 'Guarded SQL summary',
                 CASE route WHEN 'top_products' THEN top_products ELSE top_expenses END, 'safe_sql_assistant'
          FROM classified c JOIN insights i ON i.workspace_id = c.workspace_id WHERE NOT refused AND route IS NOT NULL
          UNION ALL
          SELECT d.workspace_id, d.question_id, 4 + ord, label, detail, source
          FROM cited d JOIN classified c ON c.question_id = d.question_id WHERE NOT refused)""",
    "k11_scheduler_log": f"""
        SELECT ws.workspace_id, 'brief-' || substr(sha256(ws.workspace_id || chr(31) || '1998-06-15'), 1, 32) AS morning_brief_id,
               1 AS anomaly_count, greatest(1, count(u.id)) AS due_reminder_count
        FROM ws LEFT JOIN unpaid u ON u.workspace_id = ws.workspace_id AND u.due_date <= {AS_OF} GROUP BY 1""",
    "s1_ingested_entries": """
        SELECT id, CAST(amount_inr - 10 AS DOUBLE) AS amount_inr,
               CASE WHEN amount_inr < 10 THEN 'negative_amount' ELSE '' END AS reasons
        FROM expenses""",
    "s2_ingested_once": """
        SELECT 'w' || workspace_id AS workspace_id, id, CAST(occurred_on AS VARCHAR) AS occurred_on, label,
               CAST(amount_inr AS DOUBLE) AS amount_inr
        FROM expenses WHERE event_type = 'error'
        UNION ALL
        SELECT 'w' || workspace_id, min_by(id, {'a': created_at, 'b': id}), CAST(occurred_on AS VARCHAR), label,
               CAST(amount_inr AS DOUBLE)
        FROM expenses GROUP BY workspace_id, occurred_on, label, amount_inr
        HAVING count(*) FILTER (event_type = 'error') = 0""",
    "s2_late_entries_once": """
        SELECT DISTINCT 'w' || workspace_id AS workspace_id, CAST(occurred_on AS VARCHAR) AS occurred_on, label,
               CAST(amount_inr AS DOUBLE) AS amount_inr
        FROM expenses""",
    "s3_streamed_obligation_statuses": _OBLIGATIONS_AFTER,
    "s3_streamed_action_statuses": _ACTIONS_AFTER,
    "s4_live_daily_totals": """
        SELECT 'w' || workspace_id AS workspace_id, CAST(occurred_on AS VARCHAR) AS day,
               CAST(sum(amount_inr) AS DOUBLE) AS daily_total
        FROM expenses GROUP BY ALL""",
}

for _kept, _whole in {
    "k1_kept_stats": "k1_dashboard_stats",
    "k2_kept_series": "k2_margin_series",
    "k4_kept_summaries": "k4_collection_summaries",
    "k7_kept_brief": "k7_owner_brief",
}.items():
    QUERIES[_kept] = QUERIES[_whole]


def all_sql() -> dict[str, str]:
    every = {name: sql(body) for name, body in QUERIES.items()}
    changed = "CASE WHEN doc_id % 10 = 3 THEN 'again ' || text ELSE text END AS summary"
    every["c10_refreshed_index"] = every["c10_refreshed_index"].replace("text AS summary", changed)
    return every
