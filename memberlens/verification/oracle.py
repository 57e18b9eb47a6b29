"""The marts and blocks once more, as SQL for DuckDB over the test tables.

Written from the definitions, not from the Spark jobs: conditions on members are
set tests (``EXISTS``), counts are ``count(DISTINCT ...) FILTER``, and nothing is
reduced before it is joined.
"""

from __future__ import annotations

from datetime import date, datetime

INPUTS = """
    ord AS (
        SELECT o_orderkey AS k, o_custkey AS cust, o_orderpriority AS priority,
               o_orderstatus AS status, o_orderdate + INTERVAL 24 YEAR AS ts
        FROM orders),
    cus AS (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer),
    sales AS (
        SELECT k, cust::VARCHAR AS crm_member_id, ts::DATE AS date_id,
               CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END AS is_rrp_sales_type,
               CASE WHEN k % 9 = 0 THEN 'LBR' WHEN k % 11 <> 0 THEN 'D1' END
                   AS distributor_name,
               status <> 'P' AS if_eff_order_tag
        FROM ord),
    counted AS (
        SELECT * FROM sales
        WHERE is_rrp_sales_type = 1 AND distributor_name <> 'LBR' AND if_eff_order_tag),
    first_order AS (
        SELECT k FROM counted
        QUALIFY row_number() OVER (PARTITION BY crm_member_id ORDER BY date_id, k) = 1),
    member_order AS (
        SELECT *, CASE WHEN k IN (FROM first_order) THEN '会员生命周期首单' ELSE 'repeat' END
                      AS initial_vs_repurchase_lifecycle
        FROM sales),
    joined AS (
        SELECT k, segment,
               coalesce(
                   (SELECT min(date_id) FROM counted WHERE crm_member_id = cus.k::VARCHAR)
                   - [0, 5, 10, 20, 60, 120, 300, 361, 500, -4, 1, NULL][k % 12 + 1],
                   DATE '2023-06-01' + (k % 700)::INTEGER) AS joined_on
        FROM cus),
    member AS (
        SELECT k::VARCHAR AS member_detail_id, joined_on::TIMESTAMP AS join_time,
               CASE segment WHEN 'FURNITURE' THEN 'BRANDWMP' WHEN 'BUILDING' THEN 'LCS_STORE'
                    WHEN 'HOUSEHOLD' THEN 'DOUYIN' WHEN 'AUTOMOBILE' THEN 'BRANDEC' END
                   AS eff_reg_channel
        FROM joined
        UNION ALL
        SELECT k::VARCHAR, (joined_on + 400)::TIMESTAMP, 'WMP_LCS'
        FROM joined WHERE k % 50 = 7),
    line_once AS (
        SELECT k, ts AS order_paid_date,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'TMALL' WHEN 'AO' THEN 'DOUYIN'
                    WHEN 'NF' THEN 'DOUYIN_B2B' ELSE 'LCS' END AS source_channel,
               l_linenumber AS line,
               l_linenumber % 4 AS sales_type,
               CASE WHEN l_linenumber = 7 THEN 'presale' ELSE 'normal' END AS order_type,
               CASE WHEN l_linenumber = 6 THEN 'other' ELSE 'CRM_memberid' END AS type_name,
               'tv' || cust AS type_value,
               CASE WHEN k % 8 <> 5 THEN cust::VARCHAR END AS crm_member_detail_id,
               status <> 'P' AS if_eff_order_tag,
               (CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT
                   AS sales_qty,
               k % 5 <> 0 AS is_member_order,
               l_extendedprice::DECIMAL(18, 2) AS order_rrp_amt,
               k AS parent_order_id, k AS original_order_id,
               CASE WHEN k % 2 = 0 THEN 'WOS企微小程序-新场景' ELSE 'other' END AS payment_type
        FROM lineitem JOIN ord ON l_orderkey = k),
    order_line AS (
        SELECT * FROM line_once
        UNION ALL SELECT * FROM line_once WHERE k % 10 = 3 AND line = 1),
    crm_map AS (
        SELECT k AS id, CASE WHEN k % 20 <> 0 THEN k END AS member_id FROM cus
        UNION ALL SELECT k + 1, CASE WHEN k % 20 <> 0 THEN k END FROM cus WHERE k % 60 = 1),
    contact_event AS (
        SELECT CASE WHEN k % 12 = 0 AND cust % 4 <> 3 THEN 'external_user_add'
                    ELSE 'order_placed' END AS event_key,
               epoch(ts)::BIGINT AS event_time,
               CASE WHEN k % 40 = 0 THEN 'not json'
                    ELSE '{"unionId":"u' || cust || '","store_codes":"s1"}' END AS attributes,
               'g' || cust AS gio_id
        FROM ord
        UNION ALL
        SELECT event_type, floor(epoch(ts))::BIGINT, props, 'g' || user_id FROM events),
    identity AS (
        SELECT 'g' || k AS gio_id, 'id_CRM_memberid' AS prop_key, k::VARCHAR AS prop_value,
               1 AS sign, TIMESTAMP '2024-02-01' AS update_time FROM cus
        UNION ALL
        SELECT 'g' || k, 'id_other', 'z', 1, TIMESTAMP '2024-02-01' FROM cus
        UNION ALL
        SELECT 'g' || k, 'id_CRM_memberid', (k + 1)::VARCHAR, 1, TIMESTAMP '2023-02-01'
        FROM cus WHERE k % 10 = 0
        UNION ALL
        SELECT 'g' || k, 'id_CRM_memberid', '00' || k, 1, TIMESTAMP '2022-02-01'
        FROM cus WHERE k % 40 = 0
        UNION ALL
        SELECT 'g' || k, 'id_CRM_memberid', 'bad' || k, 1, TIMESTAMP '2024-06-01'
        FROM cus WHERE k % 25 = 0
        UNION ALL
        SELECT 'g' || k, 'id_CRM_memberid', (k + 2)::VARCHAR, 0, TIMESTAMP '2024-06-01'
        FROM cus WHERE k % 30 = 0),
    page_view AS (
        SELECT 'g' || cust AS gio_id, ts AS event_time, priority AS page_type FROM ord
        UNION ALL SELECT 'g' || user_id, ts, event_type FROM events),
    contact_tag AS (
        SELECT CASE WHEN k % 7 <> 0 THEN 'u' || k END AS union_id,
               CASE k % 3 WHEN 0 THEN '乐高小程序' WHEN 1 THEN 'other' END
                   AS wecom_channel_source
        FROM cus
        UNION ALL
        SELECT CASE WHEN k % 7 <> 0 THEN 'u' || k END, '乐高小程序' FROM cus WHERE k % 21 = 1),
    staff_relation AS (
        SELECT 'u' || k AS external_user_unionid,
               k % (SELECT count(*) FROM supplier) AS staff_ext_id,
               TIMESTAMP '2024-01-01' AS relation_created_at, k % 2 AS relation_source,
               CASE WHEN k % 2 <> 0 OR k % 5 = 0 THEN 1 ELSE 0 END AS relation_deleted
        FROM cus),
    staff AS (
        SELECT s_suppkey AS staff_ext_id, s_name AS staff_name,
               CASE WHEN s_suppkey % 10 <> 4 THEN 'store' || s_suppkey END AS lego_store_code,
               'Store ' || s_suppkey AS store_name, 'D1' AS distributor, 'P1' AS partner,
               s_nationkey::VARCHAR AS region, 'LCS' AS channel
        FROM supplier),
    thirdparty_bind AS (
        SELECT CASE WHEN k % 13 = 0 THEN 'openId' ELSE 'unionId' END AS id_type,
               CASE WHEN k % 17 = 0 THEN 3 ELSE 4 END AS thirdparty_app_id, 'u' || k AS id_value,
               k::VARCHAR AS member_detail_id
        FROM cus),
    ec_history AS (
        SELECT 'registerOrBind' AS belong_type,
               CASE WHEN k % 2 = 0 THEN 'TMall' ELSE 'Douyin' END AS eff_belong_channel,
               CASE WHEN k % 3 = 0 THEN k::VARCHAR END AS member_detail_id,
               'p' || (k % 50) AS platform_id_value
        FROM cus),
    order_scenario AS (
        SELECT k AS parent_order_id,
               CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN 'Organic' ELSE 'Staff' END
                   AS order_scenario
        FROM ord
        UNION ALL SELECT k, 'Staff' FROM ord WHERE k % 16 = 0)
"""

BLOCKS = """
    latest AS (
        SELECT gio_id, try_cast(prop_value AS BIGINT) AS member_detail_id FROM identity
        WHERE prop_key = 'id_CRM_memberid' AND sign = 1
          AND regexp_full_match(prop_value, '[0-9]+')
        QUALIFY row_number() OVER (
            PARTITION BY gio_id ORDER BY update_time DESC NULLS FIRST, prop_value DESC) = 1),
    dim AS (
        SELECT try_cast(member_detail_id AS BIGINT) AS member_detail_id, join_time,
               eff_reg_channel AS raw_channel,
               CASE WHEN contains(eff_reg_channel, 'LCS') THEN 'LCS' ELSE eff_reg_channel END
                   AS eff_reg_channel,
               year(join_time) AS joined,
               CASE WHEN year(join_time) > 2022 THEN year(join_time)::VARCHAR
                    WHEN year(join_time) <= 2022 THEN '2022 及以前' END AS join_year
        FROM member),
    log AS (
        SELECT DISTINCT member_detail_id, gio_id, event_time, page_type
        FROM page_view JOIN latest USING (gio_id)
        WHERE EXISTS (
            FROM dim WHERE dim.member_detail_id = latest.member_detail_id
                       AND dim.join_time::DATE <= page_view.event_time::DATE)),
    member_days AS (
        SELECT member_detail_id, year(event_time) AS visit_year,
               count(DISTINCT event_time::DATE) AS days
        FROM log GROUP BY ALL),
    good AS (
        SELECT * FROM member_order
        WHERE is_rrp_sales_type = 1 AND distributor_name <> 'LBR' AND if_eff_order_tag),
    bought AS (
        SELECT DISTINCT try_cast(crm_member_id AS BIGINT) AS member_detail_id,
               year(date_id) AS bought_year FROM good
        WHERE try_cast(crm_member_id AS BIGINT) IS NOT NULL),
    valid AS (
        SELECT *, order_paid_date::DATE AS paid, year(order_paid_date) AS y,
               CASE WHEN source_channel IN ('DOUYIN', 'DOUYIN_B2B') THEN 'DOUYIN'
                    ELSE source_channel END AS platform,
               CASE WHEN sales_qty > 0 THEN order_rrp_amt ELSE 0 END AS sold,
               CASE WHEN sales_qty < 0 THEN abs(order_rrp_amt) ELSE 0 END AS back,
               CASE WHEN is_member_order THEN sold ELSE 0 END AS m_sold,
               CASE WHEN is_member_order THEN back ELSE 0 END AS m_back
        FROM order_line
        WHERE order_paid_date::DATE < DATE '{as_of}'
          AND CASE WHEN source_channel = 'LCS' THEN sales_type <> 3
                   WHEN source_channel IN ('TMALL', 'DOUYIN', 'DOUYIN_B2B')
                   THEN order_type = 'normal' END),
    resolved AS (
        SELECT valid.*, crm_map.id AS mapped,
               CASE WHEN type_name IN ('CRM_memberid', 'DY_openid', 'TMALL_kyid')
                    THEN coalesce(crm_map.id::VARCHAR, type_value) END AS omni
        FROM valid LEFT JOIN crm_map ON crm_map.member_id::VARCHAR = crm_member_detail_id),
    buyers AS (
        SELECT DISTINCT omni, y, source_channel FROM resolved
        WHERE if_eff_order_tag AND omni IS NOT NULL),
    lines AS (
        SELECT DISTINCT paid, source_channel, omni, if_eff_order_tag, sales_qty,
               is_member_order, order_rrp_amt, parent_order_id, platform, y,
               sold, back, m_sold, m_back
        FROM resolved),
    adds AS (
        SELECT event_key, make_timestamp(event_time * 1000000) AS event_time, attributes,
               contact_event.gio_id, prop_value AS crm_member_id,
               try_cast(prop_value AS BIGINT) AS crm_key,
               json_attr(attributes, 'unionId') AS union_id,
               wecom_channel_source AS source
        FROM contact_event
        LEFT JOIN identity
          ON identity.gio_id = contact_event.gio_id AND prop_key = 'id_CRM_memberid'
        LEFT JOIN contact_tag ON contact_tag.union_id = json_attr(attributes, 'unionId')
        WHERE event_key = 'external_user_add'
          AND make_timestamp(event_time * 1000000) < TIMESTAMP '{as_of}'),
    relations AS (
        SELECT staff_relation.*, staff.* EXCLUDE (staff_ext_id), b.member_detail_id,
               try_cast(b.member_detail_id AS BIGINT) AS still_key
        FROM staff_relation JOIN staff USING (staff_ext_id)
        LEFT JOIN thirdparty_bind b ON id_value = external_user_unionid
              AND id_type = 'unionId' AND thirdparty_app_id = 4
        WHERE lego_store_code IS NOT NULL AND relation_deleted = 0),
    scenario AS (
        SELECT DISTINCT parent_order_id::VARCHAR AS order_id, order_scenario AS scenario
        FROM order_scenario)
"""

# DuckDB raises on invalid JSON, so each use tests the text first.
JSON_ATTR = "CASE WHEN json_valid({0}) THEN json_extract_string({0}, '$.{1}') END"

QUERIES = {
    "member_visits_log": "SELECT * FROM log",
    "visitors_by_year": """
        SELECT year(event_time) AS visit_wmp_year, eff_reg_channel, join_year,
               count(DISTINCT log.member_detail_id) AS visit_wmp_member_count
        FROM log LEFT JOIN dim USING (member_detail_id) GROUP BY ALL""",
    "average_visit_days": """
        SELECT visit_year, eff_reg_channel, join_year, sum(days)::DOUBLE AS ttl_visit_days,
               count(DISTINCT m.member_detail_id) AS visit_member_count,
               sum(days)::DOUBLE / count(DISTINCT m.member_detail_id) AS avg_visit_days
        FROM member_days m LEFT JOIN dim USING (member_detail_id) GROUP BY ALL""",
    "visit_day_distribution": """
        SELECT visit_year, join_year, eff_reg_channel,
               CASE WHEN days < 5 THEN days::VARCHAR ELSE 'greater than 5' END
                   AS visit_day_count,
               count(DISTINCT m.member_detail_id) AS member_count
        FROM member_days m LEFT JOIN dim USING (member_detail_id) GROUP BY ALL""",
    "revisiting_members": """
        SELECT visit_year, join_year, eff_reg_channel,
               count(DISTINCT m.member_detail_id) AS visit_member_count,
               count(DISTINCT m.member_detail_id) FILTER (days > 1) AS revisit_member_count
        FROM member_days m LEFT JOIN dim USING (member_detail_id) GROUP BY ALL""",
    "revisit_gaps": """
        , days AS (
            SELECT DISTINCT log.member_detail_id, joined, join_year, eff_reg_channel,
                   event_time::DATE AS day, year(event_time) AS visit_year
            FROM log LEFT JOIN dim USING (member_detail_id)),
        numbered AS (
            SELECT *, row_number() OVER (
                PARTITION BY member_detail_id, visit_year
                ORDER BY day, joined NULLS LAST, eff_reg_channel NULLS LAST) AS n
            FROM days),
        gaps AS (
            SELECT b.*, date_diff('day', a.day, b.day) AS gap
            FROM numbered a JOIN numbered b USING (member_detail_id, visit_year)
            WHERE a.n = 1 AND b.n = 2)
        SELECT visit_year, join_year, eff_reg_channel,
               CASE WHEN gap > 360 THEN '> 361 days' WHEN gap > 180 THEN '181-360 days'
                    WHEN gap > 90 THEN '91-180 days' WHEN gap > 60 THEN '61-90 days'
                    WHEN gap > 30 THEN '31-60 days' WHEN gap > 14 THEN '15-30 days'
                    WHEN gap > 7 THEN '8-14 days' WHEN gap > 0 THEN '1-7 days' END
                   AS time_diff,
               count(DISTINCT member_detail_id) AS member_count
        FROM gaps GROUP BY ALL""",
    "same_year_buyers": """
        , flagged AS (
            SELECT DISTINCT member_detail_id, year(event_time) AS visit_year FROM log)
        SELECT visit_year,
               ((f.member_detail_id, visit_year) IN (FROM bought))::BIGINT AS "YTD_converted",
               eff_reg_channel, count(DISTINCT f.member_detail_id) AS ttl_member_count
        FROM flagged f LEFT JOIN dim USING (member_detail_id) GROUP BY ALL""",
    "page_penetration": """
        , buyer AS (
            SELECT DISTINCT member_detail_id FROM log
            WHERE (member_detail_id, year(event_time)) IN (FROM bought)),
        seen AS (
            SELECT year(event_time) AS visit_year,
                   (log.member_detail_id IN (FROM buyer))::BIGINT AS bought_once,
                   eff_reg_channel, page_type, log.member_detail_id AS m
            FROM log LEFT JOIN dim USING (member_detail_id)),
        cells AS (
            SELECT visit_year, bought_once, eff_reg_channel, count(DISTINCT m) AS total
            FROM seen GROUP BY ALL),
        page AS (
            SELECT visit_year, bought_once, eff_reg_channel, page_type,
                   count(DISTINCT m) AS n
            FROM seen GROUP BY ALL)
        SELECT visit_year, bought_once AS "YTD_converted", eff_reg_channel, page_type,
               n AS member_count, total AS ttl_member_count, n::DOUBLE / total AS visit_penetration
        FROM page LEFT JOIN cells USING (visit_year, bought_once, eff_reg_channel)""",
    "registered_and_visited": """
        , registered AS (
            SELECT CASE WHEN contains(eff_reg_channel, 'LCS') THEN 'LCS'
                        ELSE eff_reg_channel END AS eff_reg_channel,
                   count(member_detail_id) AS n
            FROM member GROUP BY ALL
            UNION ALL
            SELECT label, (SELECT count(DISTINCT platform_id_value) FROM ec_history
                           WHERE member_detail_id IS NULL AND belong_type = 'registerOrBind'
                             AND eff_belong_channel = origin)
            FROM (VALUES ('BRANDEC', 'TMall'), ('DOUYIN', 'Douyin')) v(label, origin)),
        visited AS (
            SELECT eff_reg_channel, count(DISTINCT member_detail_id) AS n FROM dim
            WHERE member_detail_id IN (SELECT member_detail_id FROM log) GROUP BY ALL)
        SELECT r.eff_reg_channel, sum(r.n)::BIGINT AS reg_member_count,
               any_value(visited.n) AS member_visit_count,
               strftime(TIMESTAMP '{load_time}', '%Y%m%d') AS dl_batch_date,
               TIMESTAMP '{load_time}' AS dl_load_time
        FROM registered r LEFT JOIN visited ON visited.eff_reg_channel = r.eff_reg_channel
        GROUP BY ALL""",
    "days_to_first_purchase": """
        , gaps AS (
            SELECT m.member_detail_id, year(join_time) AS joined,
                   date_diff('day', join_time::DATE, date_id) AS gap
            FROM member m LEFT JOIN (
                FROM good WHERE initial_vs_repurchase_lifecycle = '会员生命周期首单') f
              ON try_cast(f.crm_member_id AS BIGINT) = try_cast(m.member_detail_id AS BIGINT)
            WHERE contains(eff_reg_channel, 'WMP'))
        SELECT CASE WHEN joined > 2022 THEN joined::VARCHAR
                    WHEN joined <= 2022 THEN '2022及以前' END AS reg_year,
               CASE WHEN gap < 0 OR gap = 361 OR gap IS NULL THEN '未转化'
                    WHEN gap < 1 THEN '1 - 当天转化' WHEN gap < 8 THEN '2 - 1-7天转化'
                    WHEN gap < 15 THEN '3 - 8-14天转化' WHEN gap < 31 THEN '4 - 15-30'
                    WHEN gap < 91 THEN '5 - 31-90' WHEN gap < 181 THEN '6 - 91-180'
                    WHEN gap < 361 THEN '7 - 181-360' ELSE '8 - 361+' END
                   AS days_to_0_1_convert,
               count(DISTINCT member_detail_id) AS member_count
        FROM gaps GROUP BY ALL""",
    "conversion_by_cohort": """
        , r AS (
            SELECT m.member_detail_id AS id,
                   CASE WHEN year(join_time) > 2022 THEN year(join_time)::VARCHAR
                        WHEN year(join_time) <= 2022 THEN '2022 and before' END AS reg_year,
                   id IN (SELECT omni FROM buyers) AS ltd,
                   EXISTS (FROM buyers WHERE omni = id AND y = year(join_time)) AS ytd,
                   EXISTS (FROM buyers WHERE omni = id AND y = year(join_time)
                             AND source_channel = 'LCS') AS lcs,
                   EXISTS (FROM buyers WHERE omni = id AND y = year(join_time)
                             AND source_channel = 'TMALL') AS tmall,
                   EXISTS (FROM buyers WHERE omni = id AND y = year(join_time)
                             AND source_channel LIKE 'DOUYIN%') AS dy,
                   EXISTS (FROM adds WHERE crm_key = try_cast(id AS BIGINT)) AS added
            FROM member m WHERE eff_reg_channel = 'BRANDWMP')
        SELECT reg_year, count(DISTINCT id) AS reg_member,
               count(DISTINCT id) FILTER (ltd) AS ltd_omni_converted_member,
               count(DISTINCT id) FILTER (ytd) AS ytd_omni_converted_member,
               count(DISTINCT id) FILTER (lcs) AS ytd_lcs_converted_member,
               count(DISTINCT id) FILTER (tmall) AS ytd_tmall_converted_member,
               count(DISTINCT id) FILTER (dy) AS ytd_dy_converted_member,
               count(DISTINCT id) FILTER (added) AS add_wecom_member,
               count(DISTINCT id) FILTER (added AND lcs) AS add_wecom_and_ytd_lcs_converted,
               count(DISTINCT id) FILTER (NOT added) AS not_add_wecom_member,
               count(DISTINCT id) FILTER (NOT added AND lcs)
                   AS not_add_wecom_but_ytd_lcs_converted
        FROM r GROUP BY ALL""",
    "recruitment_funnel": """
        , r AS (
            SELECT m.member_detail_id AS id,
                   CASE WHEN year(join_time) > 2022 THEN year(join_time)::VARCHAR
                        WHEN year(join_time) <= 2022 THEN '2022 and before' END AS reg_year,
                   EXISTS (FROM adds WHERE crm_key::VARCHAR = id) AS a,
                   EXISTS (FROM adds WHERE crm_key::VARCHAR = id AND source = '乐高小程序') AS w,
                   EXISTS (FROM relations WHERE still_key::VARCHAR = id) AS s,
                   EXISTS (FROM buyers WHERE omni = id AND source_channel = 'LCS') AS ltd,
                   EXISTS (FROM buyers WHERE omni = id AND source_channel = 'LCS'
                             AND y = year(join_time)) AS ytd
            FROM member m WHERE eff_reg_channel = 'BRANDWMP'),
        n AS (
            SELECT reg_year, count(DISTINCT id) AS reg,
                   count(DISTINCT id) FILTER (a) AS a, count(DISTINCT id) FILTER (s) AS s,
                   count(DISTINCT id) FILTER (w) AS w,
                   count(DISTINCT id) FILTER (w AND s) AS w_s,
                   count(DISTINCT id) FILTER (a AND ltd) AS a_ltd,
                   count(DISTINCT id) FILTER (w AND ltd) AS w_ltd,
                   count(DISTINCT id) FILTER (a AND ytd) AS a_ytd,
                   count(DISTINCT id) FILTER (w AND ytd) AS w_ytd
            FROM r GROUP BY ALL)
        SELECT reg_year, reg AS reg_member, a::DOUBLE / nullif(reg, 0) AS wecom_added_ratio,
               a AS add_wecom_member, s AS add_wecom_member_still_added,
               s::DOUBLE / nullif(a, 0) AS wecom_still_added_ratio,
               w AS add_wecom_through_wmp_member,
               w_s AS add_wecom_through_wmp_member_and_still_added,
               w_s::DOUBLE / nullif(w, 0) AS wecom_through_wmp_still_added_ratio,
               a_ltd AS add_wecom_and_ltd_converted_member,
               w_ltd AS add_wecom_through_wmp_and_ltd_converted_member,
               a_ltd::DOUBLE / nullif(a, 0) AS "add_wecom_ltd_CR",
               w_ltd::DOUBLE / nullif(w, 0) AS "add_wecom_through_wmp_member_ltd_CR",
               a_ytd AS add_wecom_and_ytd_converted_member,
               w_ytd AS add_wecom_through_wmp_and_ytd_converted_member,
               a_ytd::DOUBLE / nullif(a, 0) AS "add_wecom_ytd_CR",
               w_ytd::DOUBLE / nullif(w, 0) AS "add_wecom_through_wmp_member_ytd_CR"
        FROM n""",
    "registrant_sales": """
        , wmp AS (SELECT member_detail_id AS omni FROM member WHERE eff_reg_channel = 'BRANDWMP'),
        tally AS (
            SELECT *, platform AS channel FROM lines
            UNION ALL SELECT *, 'Omni' FROM lines),
        mine AS (
            SELECT y, channel, count(DISTINCT omni) AS shoppers,
                   sum(m_sold) - sum(m_back) AS sales,
                   count(DISTINCT parent_order_id)
                       FILTER (is_member_order AND if_eff_order_tag) AS orders
            FROM tally JOIN wmp USING (omni) GROUP BY ALL),
        total AS (
            SELECT y, channel, sum(sold) - sum(back) AS sales,
                   count(DISTINCT omni) FILTER (is_member_order) AS shoppers,
                   sum(m_sold) - sum(m_back) AS member_sales,
                   count(DISTINCT parent_order_id)
                       FILTER (is_member_order AND if_eff_order_tag) AS orders
            FROM tally GROUP BY ALL)
        SELECT y AS transaction_year, channel AS source_channel,
               mine.shoppers AS member_shopper, mine.sales::DOUBLE AS member_sales,
               mine.orders AS member_transactions,
               mine.orders::DOUBLE / nullif(mine.shoppers, 0) AS frequency,
               mine.sales::DOUBLE / nullif(mine.orders, 0) AS atv,
               total.sales::DOUBLE AS "YTD_platform_TTL",
               mine.sales::DOUBLE / nullif(total.sales, 0)::DOUBLE
                   AS "sales_share_of_YTD_platform_TTL",
               CASE WHEN channel = 'Omni' OR total.sales IS NOT NULL
                    THEN total.orders::DOUBLE / nullif(total.shoppers, 0) END
                   AS "YTD_platform_frequency",
               CASE WHEN channel = 'Omni' OR total.sales IS NOT NULL
                    THEN total.member_sales::DOUBLE / nullif(total.orders, 0) END
                   AS "YTD_platform_atv"
        FROM mine JOIN total USING (y, channel)""",
    "contact_adders_by_year": """
        , a AS (
            SELECT DISTINCT year(event_time) AS y, crm_member_id, crm_key,
                   coalesce(source = '乐高小程序', false)::BIGINT AS w
            FROM adds WHERE crm_member_id IS NOT NULL)
        SELECT a.y AS add_wecom_year, eff_reg_channel, w AS add_wecom_through_wmp,
               count(DISTINCT crm_member_id) AS member_count,
               count(DISTINCT crm_member_id)
                   FILTER (crm_key IN (SELECT still_key FROM relations
                                       WHERE still_key IS NOT NULL))
                   AS add_wecom_member_still_added,
               count(DISTINCT crm_member_id)
                   FILTER (crm_key::VARCHAR IN (SELECT omni FROM buyers
                                                WHERE source_channel = 'LCS'))
                   AS ltd_lcs_converted,
               count(DISTINCT crm_member_id)
                   FILTER ((crm_key::VARCHAR, a.y) IN (SELECT (omni, y) FROM buyers
                                                       WHERE source_channel = 'LCS'))
                   AS ytd_lcs_converted
        FROM a LEFT JOIN dim ON dim.member_detail_id = crm_key GROUP BY ALL""",
    "contact_adder_sales": """
        , one AS (
            SELECT DISTINCT y, paid, omni, if_eff_order_tag, sales_qty, is_member_order,
                   order_rrp_amt, m_sold, m_back
            FROM lines WHERE source_channel = 'LCS'),
        adder AS (
            SELECT crm_member_id, crm_key::VARCHAR AS omni, min(year(event_time)) AS since
            FROM adds WHERE crm_member_id IS NOT NULL GROUP BY ALL),
        by_wmp AS (
            SELECT DISTINCT crm_member_id, crm_key::VARCHAR AS omni FROM adds
            WHERE source = '乐高小程序'),
        still AS (
            SELECT DISTINCT member_detail_id, still_key::VARCHAR AS omni FROM relations),
        mine AS (
            SELECT y, (still.omni IS NOT NULL)::BIGINT AS s, (by_wmp.omni IS NOT NULL)::BIGINT AS w,
                   count(DISTINCT one.omni) AS shoppers,
                   sum(m_sold) - sum(m_back) AS sales
            FROM one JOIN adder ON adder.omni = one.omni AND since <= y
            LEFT JOIN by_wmp ON by_wmp.omni = one.omni
            LEFT JOIN still ON still.omni = one.omni
            GROUP BY ALL),
        total AS (
            SELECT y, sum(sold) - sum(back) AS sales
            FROM valid WHERE source_channel = 'LCS' GROUP BY ALL)
        SELECT y AS transaction_year, 'LCS' AS source_channel, s AS if_still_added_wecom,
               w AS if_added_wecom_through_wmp, shoppers AS member_shopper,
               mine.sales::DOUBLE AS member_sales, total.sales::DOUBLE AS "YTD_platform_TTL",
               mine.sales::DOUBLE / nullif(total.sales, 0)::DOUBLE
                   AS "sales_share_of_YTD_platform_TTL"
        FROM mine LEFT JOIN total USING (y)""",
    "assistant_sales": """
        , newcomer AS (
            SELECT DISTINCT member_detail_id AS text_id,
                   try_cast(member_detail_id AS BIGINT) AS id
            FROM member WHERE year(join_time) = year(DATE '{as_of}')),
        t AS (
            SELECT y, mapped, parent_order_id AS o, scenario IS NOT DISTINCT FROM 'Organic' AS org,
                   raw_channel = 'BRANDWMP' AS wmp, contains(raw_channel, 'LCS') AS lcs,
                   newcomer.id IS NOT NULL AS new,
                   is_member_order AND if_eff_order_tag AS me,
                   sold, back, m_sold, m_back
            FROM resolved
            LEFT JOIN dim ON dim.member_detail_id = try_cast(crm_member_detail_id AS BIGINT)
            LEFT JOIN scenario ON order_id = original_order_id::VARCHAR
            LEFT JOIN newcomer ON newcomer.id = mapped
            WHERE source_channel = 'LCS' AND payment_type = 'WOS企微小程序-新场景'),
        n AS (
            SELECT y, count(DISTINCT mapped) FILTER (me) AS shoppers,
                   sum(m_sold) - sum(m_back) AS sales, sum(sold) - sum(back) AS all_sales,
                   count(DISTINCT o) FILTER (me) AS orders,
                   count(DISTINCT mapped) FILTER (me AND org) AS org_shoppers,
                   sum(CASE WHEN org THEN m_sold ELSE 0 END)
                       - sum(CASE WHEN org THEN m_back ELSE 0 END) AS org_sales,
                   sum(CASE WHEN org THEN sold ELSE 0 END)
                       - sum(CASE WHEN org THEN back ELSE 0 END) AS org_all_sales,
                   count(DISTINCT o) FILTER (me AND org) AS org_orders,
                   count(DISTINCT mapped) FILTER (me AND org AND wmp) AS wmp,
                   count(DISTINCT mapped) FILTER (me AND org AND lcs) AS lcs,
                   count(DISTINCT mapped) FILTER (me AND org AND wmp AND new) AS wmp_new,
                   count(DISTINCT mapped) FILTER (me AND org AND lcs AND new) AS lcs_new
            FROM t GROUP BY ALL)
        SELECT y AS transaction_year, nullif(shoppers, 0) AS wos_member_shopper_ttl,
               sales::DOUBLE AS wos_member_sales_ttl, all_sales::DOUBLE AS wos_sales_ttl,
               sales::DOUBLE / nullif(orders, 0) AS wos_member_atv_ttl,
               orders::DOUBLE / nullif(shoppers, 0) AS wos_member_frequency_ttl,
               nullif(org_shoppers, 0) AS wos_member_shopper_from_wmp,
               org_sales::DOUBLE AS wos_member_sales_from_wmp,
               org_all_sales::DOUBLE AS wos_ttl_sales_from_wmp,
               org_sales::DOUBLE / nullif(org_orders, 0) AS wos_member_atv_from_wmp,
               org_orders::DOUBLE / nullif(org_shoppers, 0) AS wos_member_frequency_from_wmp,
               nullif(wmp, 0) AS wos_member_shopper_wmp_reg,
               nullif(lcs, 0) AS wos_member_shopper_lcs_reg,
               nullif(wmp_new, 0) AS wos_member_shopper_wmp_reg_new,
               nullif(lcs_new, 0) AS wos_member_shopper_lcs_reg_new
        FROM n""",
    "block_all_identities": """
        SELECT gio_id, prop_value AS crm_member_id FROM identity
        WHERE prop_key = 'id_CRM_memberid'""",
    "block_valid_orders": """
        SELECT source_channel, order_type, sales_type::BIGINT AS sales_type,
               count(*) FILTER (order_paid_date::DATE < DATE '{as_of}'
                   AND CASE WHEN source_channel = 'LCS' THEN sales_type <> 3
                            WHEN source_channel IN ('TMALL', 'DOUYIN', 'DOUYIN_B2B')
                            THEN order_type = 'normal' END) AS valid,
               count(*) AS lines
        FROM order_line GROUP BY ALL""",
    "block_net_sales": """
        SELECT y AS transaction_year, platform,
               (sum(sold) - sum(back))::DOUBLE AS sales,
               (sum(m_sold) - sum(m_back))::DOUBLE AS member_sales,
               count(DISTINCT parent_order_id) AS transactions,
               (sum(sold) - sum(back))::DOUBLE / nullif(count(DISTINCT parent_order_id), 0) AS atv
        FROM valid GROUP BY ALL""",
    "block_labels": """
        , m AS (
            SELECT CASE WHEN contains(eff_reg_channel, 'LCS') THEN 'LCS' ELSE eff_reg_channel END
                       AS channel,
                   year(join_time) AS y, month(join_time) AS mo,
                   date_diff('day', join_time::DATE, DATE '{as_of}') AS d
            FROM member)
        SELECT channel,
               CASE WHEN y <= 2022 THEN '2022 及以前' ELSE y::VARCHAR END AS a,
               CASE WHEN y <= 2022 THEN '2022及以前' ELSE y::VARCHAR END AS b,
               CASE WHEN y <= 2022 THEN '2022 and before' ELSE y::VARCHAR END AS c,
               CASE WHEN d > 360 THEN '> 361 days' WHEN d > 180 THEN '181-360 days'
                    WHEN d > 90 THEN '91-180 days' WHEN d > 60 THEN '61-90 days'
                    WHEN d > 30 THEN '31-60 days' WHEN d > 14 THEN '15-30 days'
                    WHEN d > 7 THEN '8-14 days' WHEN d > 0 THEN '1-7 days' END AS revisit,
               CASE WHEN d > 361 THEN '8 - 361+' WHEN d = 361 OR d < 0 OR d IS NULL THEN '未转化'
                    WHEN d > 180 THEN '7 - 181-360' WHEN d > 90 THEN '6 - 91-180'
                    WHEN d > 30 THEN '5 - 31-90' WHEN d > 14 THEN '4 - 15-30'
                    WHEN d > 7 THEN '3 - 8-14天转化' WHEN d > 0 THEN '2 - 1-7天转化'
                    ELSE '1 - 当天转化' END AS conversion,
               CASE WHEN mo < 5 THEN mo::VARCHAR WHEN mo IS NOT NULL THEN 'greater than 5' END
                   AS frequency,
               count(*) AS members
        FROM m GROUP BY ALL""",
    "block_buying_years_of": """
        SELECT omni AS omni_channel_member_id, y AS buy_year, source_channel FROM buyers""",
    "block_latest_identity": "SELECT gio_id, member_detail_id FROM latest",
    "block_contact_adds": """
        SELECT event_key, event_time, json_attr(attributes, 'store_codes') AS store_codes,
               union_id AS "unionId",
               json_attr(attributes, 'external_userId') AS "external_userId",
               json_attr(attributes, 'add_way') AS add_way,
               json_attr(attributes, 'code_name') AS code_name,
               crm_member_id, source AS latest_wecom_channel_source
        FROM adds""",
    "block_current_relations": """
        SELECT member_detail_id, external_user_unionid, staff_ext_id, staff_name,
               lego_store_code, store_name, distributor, partner, region, channel,
               relation_created_at,
               relation_source::BIGINT AS created_type, relation_deleted::BIGINT AS relation_deleted
        FROM relations""",
    "block_omni_member_ids": """
        SELECT DISTINCT type_name, type_value, crm_member_detail_id,
               omni AS omni_channel_member_id
        FROM resolved""",
    "block_lcs_buyers": """
        SELECT DISTINCT omni AS omni_channel_member_id FROM buyers
        WHERE source_channel = 'LCS'""",
    "block_buying_years": """
        SELECT omni AS omni_channel_member_id, y AS buy_year, source_channel FROM buyers""",
    "block_distinct_lines": """
        SELECT paid AS order_paid_date, source_channel, omni AS omni_channel_member_id,
               if_eff_order_tag, sales_qty, is_member_order,
               order_rrp_amt::DOUBLE AS order_rrp_amt, parent_order_id
        FROM lines""",
    "block_purchase_days": "SELECT DISTINCT crm_member_id, date_id FROM good",
    "block_platform_totals": """
        , tally AS (
            SELECT *, platform AS channel FROM lines
            UNION ALL SELECT *, 'Omni' FROM lines)
        SELECT y AS transaction_year, channel AS source_channel,
               (sum(sold) - sum(back))::DOUBLE AS total_sales,
               count(DISTINCT omni) FILTER (is_member_order) AS member_shopper,
               (sum(m_sold) - sum(m_back))::DOUBLE AS member_sales,
               count(DISTINCT parent_order_id) FILTER (is_member_order AND if_eff_order_tag)
                   AS transactions
        FROM tally GROUP BY ALL""",
    "block_raw_lcs_totals": """
        SELECT y AS transaction_year,
               (sum(sold) - sum(back))::DOUBLE AS total_sales
        FROM valid WHERE source_channel = 'LCS' GROUP BY ALL""",
    "block_line_copies": """
        , raw AS (SELECT y, source_channel, count(*) AS n FROM valid GROUP BY ALL)
        SELECT y AS transaction_year, source_channel, count(*) AS distinct_lines,
               any_value(n)::BIGINT AS lines
        FROM lines JOIN raw USING (y, source_channel) GROUP BY ALL""",
    "block_visit_years": """
        , days AS (
            SELECT DISTINCT member_detail_id, year(event_time) AS visit_year,
                   event_time::DATE AS day FROM log),
        ordered AS (
            SELECT member_detail_id, visit_year, list(day ORDER BY day) AS days
            FROM days GROUP BY ALL)
        SELECT member_detail_id, visit_year, len(days)::BIGINT AS visit_days,
               days[1] AS first_day, days[2] AS second_day
        FROM ordered""",
}
QUERIES["block_refreshed_mart"] = QUERIES["registrant_sales"]


def statements(
    as_of: date, load_time: datetime, inputs: str | None = INPUTS
) -> dict[str, str]:
    """One statement per query; without ``inputs`` over tables named by input role."""
    clock = {"{as_of}": as_of.isoformat(), "{load_time}": load_time.isoformat(sep=" ")}
    tables = f"{inputs}, {BLOCKS}" if inputs else BLOCKS

    def complete(select: str) -> str:
        text = f"WITH {tables} {select}"
        for name, value in clock.items():
            text = text.replace(name, value)
        for field in ["unionId", "store_codes", "external_userId", "add_way", "code_name"]:
            call = f"json_attr(attributes, '{field}')"
            text = text.replace(call, JSON_ATTR.format("attributes", field))
        return text

    return {name: complete(select) for name, select in QUERIES.items()}
