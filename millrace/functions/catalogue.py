"""The scalar functions by category: an expression over a table for each, and its SQL twin.

An entry is (column, Spark expression, twin): the twin is the DuckDB expression,
``SAME`` where one text serves both, or None where DuckDB has no such function
(the tests then hold the function against fixed values). ``{x}`` style names are table columns.
"""

from __future__ import annotations

SAME = "="

#: category -> (table, key column, entries)
CATALOGUE: dict[str, tuple[str, str, list[tuple[str, str, str | None]]]] = {
    "array": ("embeddings", "vec_id", [
        ("array", "array(vec_id, label)", "[vec_id, label::BIGINT]"),
        ("array_append", "array_append(array(vec_id), 7L)", "list_append([vec_id], 7::BIGINT)"),
        ("array_compact", "array_compact(array(vec_id, NULL, 3L))", "list_filter([vec_id, NULL, 3], lambda x: x IS NOT NULL)"),
        ("array_contains", "array_contains(array(label, 3), 3)", "list_contains([label, 3], 3)"),
        ("array_contains_all", "array_contains_all(array(label, 3, 4), array(3, 5))", "label = 5"),
        ("array_distinct", "sort_array(array_distinct(array(label, label, 2)))", "list_sort(list_distinct([label, label, 2]))"),
        ("array_except", "array_except(array(label, 2, 3), array(2, 3))", "CASE WHEN label IN (2, 3) THEN []::INT[] ELSE [label] END"),
        ("array_insert", "array_insert(array(1L, 2L), 2, vec_id)", "[1, vec_id, 2]"),
        ("array_intersect", "array_intersect(array(label, 2), array(2))", "[2]"),
        ("array_join", "array_join(array('a', NULL, cast(label AS string)), '-', 'n')", "concat('a-n-', label)"),
        ("array_max", "round(cast(array_max(embedding) AS double), 5)", "round(list_max(embedding)::DOUBLE, 5)"),
        ("array_min", "round(cast(array_min(embedding) AS double), 5)", "round(list_min(embedding)::DOUBLE, 5)"),
        ("array_position", "array_position(array(9, label, 3), 3)", "CASE WHEN label = 3 THEN 2 ELSE 3 END"),
        ("array_prepend", "array_prepend(array(vec_id), 7L)", "[7, vec_id]"),
        ("array_remove", "array_remove(array(label, 3, 11), 3)", "list_filter([label, 3, 11], lambda x: x <> 3)"),
        ("array_repeat", "array_repeat(label, 2)", "[label, label]"),
        ("array_size", "array_size(embedding)", "len(embedding)"),
        ("array_union", "array_union(array(label), array(11, label))", "[label, 11]"),
        ("arrays_overlap", "arrays_overlap(array(label), array(1, 2))", "list_has_any([label], [1, 2])"),
        ("arrays_zip", "to_json(arrays_zip(array(label), array(1)))", """'[{"0":' || label || ',"1":1}]'"""),
        ("flatten", "flatten(array(array(label), array(1, 2)))", "flatten([[label], [1, 2]])"),
        ("get", "round(cast(get(embedding, 0) AS double), 5)", "round(embedding[1]::DOUBLE, 5)"),
        ("sequence", "sequence(1, label + 1)", "range(1, label + 2)"),
        ("shuffle", "size(shuffle(embedding))", "len(embedding)"),
        ("slice", "transform(slice(embedding, 2, 2), x -> round(cast(x AS double), 5))", "list_transform(embedding[2:3], lambda x: round(x::DOUBLE, 5))"),
        ("sort_array", "sort_array(array(label, 3, NULL, 1), false)", "list_sort([label, 3, NULL, 1], 'DESC', 'NULLS LAST')"),
    ]),
    "bitwise": ("orders", "o_orderkey", [
        ("bit_and", "o_orderkey & 6", SAME), ("bit_or", "o_orderkey | 5", SAME), ("bit_xor", "o_orderkey ^ 3", "xor(o_orderkey, 3)"), ("bit_not", "~o_orderkey", SAME),
        ("bit_count", "bit_count(o_orderkey)", SAME), ("bit_get", "bit_get(o_orderkey, 2)", "(o_orderkey >> 2) & 1"), ("getbit", "getbit(o_orderkey, 0)", "o_orderkey & 1"),
        ("shiftleft", "shiftleft(o_orderkey, 3)", "o_orderkey * 8"), ("shl", "o_orderkey << 2", "o_orderkey * 4"), ("shiftright", "shiftright(o_orderkey, 1)", "o_orderkey >> 1"), ("shr", "o_orderkey >> 2", SAME),
        ("shiftrightunsigned", "shiftrightunsigned(o_orderkey, 1)", "o_orderkey >> 1"), ("ushr", "o_orderkey >>> 2", "o_orderkey >> 2"),
    ]),
    "collection": ("embeddings", "vec_id", [
        ("cardinality", "cardinality(embedding)", "len(embedding)"), ("deep_size", "deep_size(array(array(label, 1), array(2)))", "3"),
        ("element_at", "round(cast(element_at(embedding, -1) AS double), 5)", "round(embedding[-1]::DOUBLE, 5)"), ("size", "size(embedding)", "len(embedding)"), ("size_null", "size(cast(NULL AS array<int>))", "NULL::INT"),
        ("concat", "concat(array(label), array(1, 2))", "list_concat([label], [1, 2])"), ("reverse", "reverse(array(label, 1, 2))", "[2, 1, label]"), ("try_element_at", "try_element_at(array(label, 7), label + 1)", "CASE WHEN label = 0 THEN 0 WHEN label = 1 THEN 7 END"),
    ]),
    "conditional": ("orders", "o_orderkey", [
        ("coalesce", "coalesce(nullif(o_orderstatus, 'F'), 'none')", SAME), ("if", "if(o_totalprice > 1000, 'a', 'b')", "CASE WHEN o_totalprice > 1000 THEN 'a' ELSE 'b' END"),
        ("ifnull", "ifnull(nullif(o_orderstatus, 'F'), 'x')", SAME), ("nanvl", "nanvl(cast('NaN' AS double), o_totalprice)", "o_totalprice"), ("nullif", "nullif(o_orderstatus, 'F')", SAME),
        ("nullifzero", "nullifzero(o_orderkey % 2)", "nullif(o_orderkey % 2, 0)"), ("nvl", "nvl(nullif(o_orderstatus, 'O'), 'y')", "coalesce(nullif(o_orderstatus, 'O'), 'y')"),
        ("nvl2", "nvl2(nullif(o_orderstatus, 'O'), 'y', 'n')", "CASE WHEN o_orderstatus <> 'O' THEN 'y' ELSE 'n' END"), ("zeroifnull", "zeroifnull(nullif(o_orderkey % 2, 1))", "0"),
        ("when", "CASE WHEN o_totalprice > 1e5 THEN 1 WHEN o_totalprice > 5e4 THEN 2 END", SAME), ("case", "CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END", SAME),
    ]),
    "conversion": ("orders", "o_orderkey", [
        ("bigint", "bigint('12')", "12::BIGINT"), ("binary", "binary(o_orderstatus)", "o_orderstatus::BLOB"), ("boolean", "boolean(o_orderkey % 2)", "(o_orderkey % 2)::BOOLEAN"), ("cast", "cast(o_totalprice AS bigint)", "trunc(o_totalprice)::BIGINT"),
        ("date", "date(o_orderdate)", "o_orderdate::DATE"), ("decimal", "decimal(o_orderkey)", "o_orderkey::DECIMAL(10,0)"), ("double", "double(o_orderkey)", "o_orderkey::DOUBLE"), ("float", "float(o_orderkey)", "o_orderkey::FLOAT"),
        ("int", "int(o_orderkey)", "o_orderkey::INT"), ("smallint", "smallint(o_orderkey % 100)", "(o_orderkey % 100)::SMALLINT"), ("string", "string(o_orderkey)", "o_orderkey::VARCHAR"), ("timestamp", "cast(timestamp('2024-01-02 03:04:05') AS timestamp_ntz)", "TIMESTAMP '2024-01-02 03:04:05'"),
        ("tinyint", "tinyint(o_orderkey % 100)", "(o_orderkey % 100)::TINYINT"), ("not_a_number", "cast('abc' AS int)", "NULL::INT"), ("try_cast", "try_cast(o_orderstatus AS int)", SAME),
    ]),
    "csv": ("orders", "o_orderkey", [
        ("from_csv", "from_csv(concat_ws(',', o_orderkey, o_orderstatus), 'k BIGINT, s STRING').s", "o_orderstatus"), ("schema_of_csv", "schema_of_csv('1,abc')", "'STRUCT<_c0: INT, _c1: STRING>'"), ("to_csv", "to_csv(struct(o_orderkey AS k, o_orderstatus AS s))", "concat_ws(',', o_orderkey, o_orderstatus)"),
    ]),
    "datetime": ("orders", "o_orderkey", [
        ("add_years", "add_years(date(o_orderdate), 2)", "(o_orderdate::DATE + INTERVAL 2 YEAR)::DATE"), ("add_months", "add_months(o_orderdate, 3)", "(o_orderdate::DATE + INTERVAL 3 MONTH)::DATE"), ("add_days", "add_days(date(o_orderdate), 9)", "o_orderdate::DATE + 9"),
        ("convert_timezone", "convert_timezone('UTC', 'Asia/Tokyo', o_orderdate)", "o_orderdate + INTERVAL 9 HOUR"), ("curdate", "curdate() >= date'2024-01-01'", "true"), ("current_date", "current_date() >= date'2024-01-01'", "true"), ("current_timestamp", "current_timestamp() > timestamp'2024-01-01'", "true"),
        ("current_timezone", "current_timezone()", "'UTC'"), ("date_add", "date_add(o_orderdate, 5)", "o_orderdate::DATE + 5"), ("date_diff", "cast(date_diff(o_orderdate, date'1995-01-01') AS bigint)", "datediff('day', DATE '1995-01-01', o_orderdate::DATE)"), ("date_format", "date_format(o_orderdate, 'yyyy/MM/dd HH:mm')", "strftime(o_orderdate, '%Y/%m/%d %H:%M')"),
        ("date_from_unix_date", "date_from_unix_date(cast(o_orderkey AS int))", "DATE '1970-01-01' + o_orderkey::INT"), ("date_part", "date_part('YEAR', o_orderdate)", "year(o_orderdate)"), ("date_sub", "date_sub(o_orderdate, 5)", "o_orderdate::DATE - 5"), ("date_trunc", "cast(date_trunc('MONTH', o_orderdate) AS timestamp_ntz)", "date_trunc('month', o_orderdate)::TIMESTAMP"),
        ("dateadd", "dateadd(o_orderdate, 5)", "o_orderdate::DATE + 5"), ("datediff", "cast(datediff(o_orderdate, date'2000-01-01') AS bigint)", "datediff('day', DATE '2000-01-01', o_orderdate::DATE)"), ("datepart", "datepart('MONTH', o_orderdate)", "month(o_orderdate)"), ("day", "day(o_orderdate)", SAME), ("dayname", "dayname(o_orderdate)", "strftime(o_orderdate, '%a')"),
        ("dayofmonth", "dayofmonth(o_orderdate)", SAME), ("dayofweek", "dayofweek(o_orderdate)", "dayofweek(o_orderdate) + 1"), ("dayofyear", "dayofyear(o_orderdate)", SAME), ("extract", "extract(QUARTER FROM o_orderdate)", SAME), ("from_unixtime", "from_unixtime(o_orderkey * 1000)", "strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%d %H:%M:%S')"),
        ("from_utc_timestamp", "cast(from_utc_timestamp(o_orderdate, 'Asia/Tokyo') AS timestamp_ntz)", "o_orderdate + INTERVAL 9 HOUR"), ("hour", "hour(o_orderdate + INTERVAL 5 HOUR)", SAME), ("last_day", "last_day(o_orderdate)", SAME), ("localtimestamp", "localtimestamp() > timestamp_ntz'2024-01-01'", "true"), ("make_date", "make_date(2020, 1 + cast(o_orderkey % 12 AS int), 3)", "make_date(2020, 1 + o_orderkey % 12, 3)"),
        ("make_dt_interval", "o_orderdate + make_dt_interval(1, 2)", "o_orderdate + INTERVAL 26 HOUR"), ("make_interval", "o_orderdate + make_interval(0, 1, 0, 2)", "o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY"), ("make_timestamp", "cast(make_timestamp(2020, 1, 2, 3, 4, 5.5) AS timestamp_ntz)", "TIMESTAMP '2020-01-02 03:04:05.5'"), ("make_timestamp_ltz", "cast(make_timestamp_ltz(2020, 1, 2, 3, 4, 5.5) AS timestamp_ntz)", "TIMESTAMP '2020-01-02 03:04:05.5'"),
        ("make_timestamp_ntz", "make_timestamp_ntz(2020, 1, 2, 3, 4, 5.5)", "TIMESTAMP '2020-01-02 03:04:05.5'"), ("make_ym_interval", "o_orderdate + make_ym_interval(1, 2)", "o_orderdate + INTERVAL 14 MONTH"), ("minute", "minute(o_orderdate + INTERVAL 7 MINUTE)", SAME), ("month", "month(o_orderdate)", SAME), ("monthname", "monthname(o_orderdate)", "strftime(o_orderdate, '%b')"),
        ("months_between", "months_between(date'2020-03-31', date'2020-01-31')", "2.0"), ("next_day", "next_day(date'2015-01-14', 'TU')", "DATE '2015-01-20'"), ("now", "now() > timestamp'2024-01-01'", "true"), ("quarter", "quarter(o_orderdate)", SAME), ("second", "second(o_orderdate + INTERVAL 9 SECOND)", SAME),
        ("timestamp_micros", "cast(timestamp_micros(o_orderkey) AS timestamp_ntz)", "make_timestamp(o_orderkey)"), ("timestamp_millis", "cast(timestamp_millis(o_orderkey) AS timestamp_ntz)", "make_timestamp(o_orderkey * 1000)"), ("timestamp_seconds", "cast(timestamp_seconds(o_orderkey) AS timestamp_ntz)", "make_timestamp(o_orderkey * 1000000)"), ("to_date", "to_date('2016-12-31', 'yyyy-MM-dd')", "DATE '2016-12-31'"),
        ("to_timestamp", "cast(to_timestamp('2016-12-31 01:02:03') AS timestamp_ntz)", "TIMESTAMP '2016-12-31 01:02:03'"), ("to_timestamp_ltz", "cast(to_timestamp_ltz('2016-12-31') AS timestamp_ntz)", "TIMESTAMP '2016-12-31'"), ("to_timestamp_ntz", "to_timestamp_ntz('2016-12-31')", "TIMESTAMP '2016-12-31'"), ("to_unix_timestamp", "to_unix_timestamp(o_orderdate)", "epoch(o_orderdate)::BIGINT"), ("to_utc_timestamp", "cast(to_utc_timestamp(o_orderdate, 'Asia/Tokyo') AS timestamp_ntz)", "o_orderdate - INTERVAL 9 HOUR"),
        ("trunc", "trunc(o_orderdate, 'YEAR')", "date_trunc('year', o_orderdate)::DATE"), ("try_to_timestamp", "cast(try_to_timestamp(CASE WHEN o_orderkey % 2 = 0 THEN cast(o_orderdate AS string) ELSE 'no' END) AS timestamp_ntz)", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP END"), ("unix_date", "unix_date(date(o_orderdate))", "datediff('day', DATE '1970-01-01', o_orderdate::DATE)::INT"), ("unix_micros", "unix_micros(cast(o_orderdate AS timestamp))", "epoch_us(o_orderdate)"), ("unix_millis", "unix_millis(cast(o_orderdate AS timestamp))", "epoch_ms(o_orderdate)"), ("unix_seconds", "unix_seconds(cast(o_orderdate AS timestamp))", "epoch(o_orderdate)::BIGINT"),
        ("unix_timestamp", "unix_timestamp(o_orderdate)", "epoch(o_orderdate)::BIGINT"), ("weekday", "weekday(o_orderdate)", "isodow(o_orderdate) - 1"), ("weekofyear", "weekofyear(o_orderdate)", SAME), ("year", "year(o_orderdate)", SAME),
    ]),
    "hash": ("orders", "o_orderkey", [
        ("crc32", "crc32('Spark')", "1557323817"), ("crc32_told_apart", "crc32(o_orderpriority) = crc32('1-URGENT')", "o_orderpriority = '1-URGENT'"), ("hash", "hash(1)", "-559580957"), ("md5", "md5(o_orderpriority)", SAME), ("sha", "sha(o_orderpriority)", "sha1(o_orderpriority)"), ("sha1", "sha1(o_orderpriority)", SAME), ("sha2", "sha2(o_orderpriority, 256)", "sha256(o_orderpriority)"), ("xxhash64", "xxhash64(o_orderpriority) = xxhash64('1-URGENT', NULL)", "o_orderpriority = '1-URGENT'"),
    ]),
    "json": ("events", "event_id", [
        ("from_json", "from_json(props, 'k BIGINT').k", "(props->>'$.k')::BIGINT"), ("get_json_object", "get_json_object(props, '$.k')", "props->>'$.k'"), ("json_array_length", "json_array_length('[1,2,3]')", "3"), ("json_object_keys", "json_object_keys(props)", "json_keys(props)"),
        ("schema_of_json", "schema_of_json('{\"k\":1}')", "'STRUCT<k: BIGINT>'"), ("to_json", "to_json(struct(event_id AS e, event_type AS t))", "to_json({'e': event_id, 't': event_type})::VARCHAR"),
    ]),
    "lambda": ("embeddings", "vec_id", [
        ("aggregate", "aggregate(array(label, 5), 0, (a, x) -> a + x)", "label + 5"), ("array_sort", "array_sort(array(3, label, 1), (a, b) -> b - a)", "list_reverse_sort([3, label, 1])"), ("exists", "exists(embedding, x -> x > 1)", "len(list_filter(embedding, lambda x: x > 1)) > 0"), ("filter", "size(filter(embedding, x -> x > 0))", "len(list_filter(embedding, lambda x: x > 0))"),
        ("forall", "forall(array(label, 3), x -> x > 4 OR x = 3)", "label > 4 OR label = 3"), ("map_filter", "map_keys(map_filter(map(1, label, 2, 100), (k, v) -> v > 50))", "[2]"), ("map_zip_with", "map_values(map_zip_with(map(1, label), map(1, 2), (k, a, b) -> a + b))", "[label + 2]"), ("reduce", "reduce(array(label, 1), 0, (a, x) -> a + x)", "label + 1"),
        ("transform", "transform(array(label, 1), x -> x * 2)", "[label * 2, 2]"), ("transform_keys", "map_keys(transform_keys(map(label, 1), (k, v) -> k + 1))", "[label + 1]"), ("transform_values", "map_values(transform_values(map(1, label), (k, v) -> v + 1))", "[label + 1]"), ("zip_with", "zip_with(array(label), array(2), (a, b) -> a * b)", "[label * 2]"),
    ]),
    "map": ("events", "event_id", [
        ("map", "map('a', event_id)['a']", "event_id"), ("map_last_wins", "map('a', 1, 'a', 2)['a']", "2"), ("map_concat", "map_concat(map(1, event_type), map(2, 'x'))[1]", "event_type"), ("map_contains_key", "map_contains_key(map(event_type, 1), 'click')", "event_type = 'click'"), ("map_entries", "map_entries(map(1, event_type))[0].value", "event_type"),
        ("map_from_arrays", "map_from_arrays(array(1), array(event_type))[1]", "event_type"), ("map_from_entries", "map_from_entries(array(struct(1, event_type)))[1]", "event_type"), ("map_keys", "map_keys(map(event_type, 1))", "[event_type]"), ("map_values", "map_values(map(1, event_type))", "[event_type]"), ("str_to_map", "str_to_map('a:1,b:2')['b']", "'2'"),
    ]),
    "math": ("orders", "o_orderkey", [
        ("mod_op", "o_orderkey % 7", SAME), ("mul", "o_orderkey * 3", SAME), ("add", "o_orderkey + 3", SAME), ("sub", "o_orderkey - 3", SAME), ("divide", "round(o_orderkey / 4, 6)", SAME), ("divide_zero", "o_totalprice / 0", "NULL::DOUBLE"),
        ("abs", "abs(o_orderkey - 100)", SAME), ("acos", "round(acos(1 / (1 + o_orderkey)), 6)", SAME), ("acosh", "round(acosh(1 + o_orderkey), 6)", SAME), ("asin", "round(asin(1 / (1 + o_orderkey)), 6)", SAME), ("asinh", "round(asinh(o_orderkey), 6)", SAME), ("atan", "round(atan(o_orderkey), 6)", SAME), ("atan2", "round(atan2(o_orderkey, 3), 6)", SAME), ("atanh", "round(atanh(1 / (2 + o_orderkey)), 6)", SAME),
        ("bin", "bin(o_orderkey)", "bin(o_orderkey)"), ("bround", "bround(o_orderkey / 2, 0)", "round_even(o_orderkey / 2, 0)"), ("cbrt", "round(cbrt(o_orderkey), 6)", SAME), ("ceil", "ceil(o_totalprice)", "ceil(o_totalprice)::BIGINT"), ("ceiling", "ceiling(o_totalprice)", "ceil(o_totalprice)::BIGINT"), ("conv", "conv(o_orderkey, 10, 16)", "printf('%X', o_orderkey)"), ("cos", "round(cos(o_orderkey), 6)", SAME), ("cosh", "round(cosh(o_orderkey % 5), 6)", SAME),
        ("cot", "round(cot(1 + o_orderkey % 3), 6)", SAME), ("csc", "round(csc(1 + o_orderkey % 3), 6)", "round(1 / sin(1 + o_orderkey % 3), 6)"), ("degrees", "round(degrees(o_orderkey), 4)", SAME), ("div", "o_orderkey div 7", "o_orderkey // 7"), ("e", "round(e(), 9)", "2.718281828::DOUBLE"), ("exp", "round(exp(o_orderkey % 5), 6)", SAME), ("expm1", "round(expm1(o_orderkey % 5), 6)", "round(exp(o_orderkey % 5) - 1, 6)"), ("factorial", "factorial(cast(o_orderkey % 10 AS int))", "factorial((o_orderkey % 10)::INT)::BIGINT"), ("floor", "floor(o_totalprice)", "floor(o_totalprice)::BIGINT"),
        ("greatest", "greatest(o_orderkey, o_custkey, NULL)", SAME), ("hex", "hex(o_orderkey)", "printf('%X', o_orderkey)"), ("hypot", "round(hypot(o_orderkey, 3), 5)", "round(sqrt(o_orderkey * o_orderkey + 9), 5)"), ("least", "least(o_orderkey, o_custkey)", SAME), ("ln", "round(ln(o_orderkey + 1), 6)", SAME), ("ln_zero", "ln(0)", "NULL::DOUBLE"), ("log", "round(log(2, o_orderkey + 1), 6)", "round(ln(o_orderkey + 1) / ln(2), 6)"), ("log10", "round(log10(o_orderkey + 1), 6)", SAME), ("log1p", "round(log1p(o_orderkey), 6)", "round(ln(1 + o_orderkey), 6)"), ("log2", "round(log2(o_orderkey + 1), 6)", SAME),
        ("mod", "mod(o_orderkey, 7)", SAME), ("negative", "negative(o_orderkey)", "-o_orderkey"), ("pi", "round(pi(), 9)", SAME), ("pmod", "pmod(-o_orderkey, 7)", "((-o_orderkey % 7) + 7) % 7"), ("positive", "positive(o_orderkey)", "o_orderkey"), ("pow", "round(pow(o_orderkey % 9, 3), 6)", SAME), ("power", "round(power(o_orderkey % 9, 2), 6)", SAME), ("radians", "round(radians(o_orderkey), 6)", SAME), ("rand", "rand(1) BETWEEN 0 AND 1", "true"), ("randn", "isnotnull(randn(1))", "true"), ("random", "random() < 1", "true"),
        ("random_poisson", "random_poisson(2.0, 7) >= 0", "true"), ("rint", "rint(o_orderkey / 2)", "round_even(o_orderkey / 2, 0)"), ("round", "round(o_totalprice, 1)", SAME), ("sec", "round(sec(o_orderkey % 3), 6)", "round(1 / cos(o_orderkey % 3), 6)"), ("sign", "sign(o_orderkey - 9)", "sign(o_orderkey - 9)::DOUBLE"), ("signum", "signum(o_orderkey - 9)", "sign(o_orderkey - 9)::DOUBLE"), ("sin", "round(sin(o_orderkey), 6)", SAME), ("sinh", "round(sinh(o_orderkey % 5), 6)", SAME), ("sqrt", "round(sqrt(o_orderkey), 6)", SAME), ("tan", "round(tan(o_orderkey % 3), 6)", SAME), ("tanh", "round(tanh(o_orderkey), 6)", SAME),
        ("try_add", "try_add(o_orderkey, CASE WHEN o_orderkey % 1000 = 1 THEN 9223372036854775807 ELSE 5 END)", "CASE WHEN o_orderkey % 1000 = 1 AND o_orderkey > 0 THEN NULL WHEN o_orderkey % 1000 = 1 THEN 9223372036854775807 ELSE o_orderkey + 5 END"), ("try_divide", "try_divide(o_orderkey, o_orderkey % 4)", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey / (o_orderkey % 4) END"), ("try_multiply", "try_multiply(o_orderkey + 2, CASE WHEN o_orderkey % 1000 = 1 THEN 9223372036854775807 ELSE 3 END)", "CASE WHEN o_orderkey % 1000 <> 1 THEN (o_orderkey + 2) * 3 END"), ("try_mod", "try_mod(o_orderkey, o_orderkey % 4)", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % (o_orderkey % 4) END"), ("try_subtract", "try_subtract(o_orderkey, 1)", "o_orderkey - 1"), ("unhex", "cast(unhex(hex(o_orderpriority)) AS string)", "o_orderpriority"), ("width_bucket", "width_bucket(o_totalprice, 0, 500000, 10)", "floor(o_totalprice / 50000)::BIGINT + 1"),
    ]),
    "misc": ("orders", "o_orderkey", [
        ("aes_encrypt", "cast(aes_decrypt(aes_encrypt(o_orderpriority, '0000111122223333'), '0000111122223333') AS string)", "o_orderpriority"), ("aes_decrypt", "cast(aes_decrypt(aes_encrypt(o_orderstatus, '0000111122223333', 'ECB'), '0000111122223333', 'ECB') AS string)", "o_orderstatus"), ("assert_true", "assert_true(o_orderkey >= 0) IS NULL", "true"), ("bitmap_bit_position", "bitmap_bit_position(o_orderkey + 1)", "o_orderkey % 32768"), ("bitmap_bucket_number", "bitmap_bucket_number(o_orderkey + 1)", "o_orderkey // 32768 + 1"), ("bitmap_count", "bitmap_count(X'FFFF')", "16"),
        ("current_catalog", "current_catalog()", "'spark_catalog'"), ("current_database", "current_database()", "'default'"), ("current_schema", "current_schema()", "'default'"), ("current_user", "current_user() IS NOT NULL", "true"), ("equal_null", "equal_null(nullif(o_orderstatus, 'F'), NULL)", "o_orderstatus = 'F'"), ("input_file_block_length", "input_file_block_length() >= -1", "true"), ("input_file_block_start", "input_file_block_start() >= -1", "true"), ("input_file_name", "input_file_name() LIKE '%orders%'", "true"), ("java_method", "java_method('java.lang.Math', 'abs', -3)", "'3'"), ("reflect", "reflect('java.lang.Math', 'abs', -4)", "'4'"),
        ("monotonically_increasing_id", "monotonically_increasing_id() >= 0", "true"), ("raise_error", "CASE WHEN o_orderkey < 0 THEN cast(raise_error('negative') AS int) END", "NULL::INT"), ("spark_partition_id", "spark_partition_id() >= 0", "true"), ("try_aes_encrypt", "try_aes_encrypt(o_orderstatus, 'short') IS NULL", "true"), ("try_aes_decrypt", "try_aes_decrypt(unhex('00'), '0000111122223333') IS NULL", "true"), ("typeof", "typeof(o_orderkey)", "'bigint'"), ("user", "user() = current_user()", "true"), ("uuid", "length(uuid())", "36"), ("version", "version() LIKE '4%'", "true"),
    ]),
    "predicate": ("orders", "o_orderkey", [
        ("bang", "!(o_orderkey > 5)", "NOT (o_orderkey > 5)"), ("ne", "o_orderkey != 5", SAME), ("lt", "o_orderkey < 5", SAME), ("le", "o_orderkey <= 5", SAME), ("null_safe_eq", "nullif(o_orderkey, 5) <=> NULL", "nullif(o_orderkey, 5) IS NOT DISTINCT FROM NULL"), ("eq", "o_orderkey = 5", SAME), ("eq2", "o_orderkey == 5", SAME), ("gt", "o_orderkey > 5", SAME), ("ge", "o_orderkey >= 5", SAME), ("and_", "o_orderkey > 5 AND o_orderkey < 9", SAME), ("or_", "o_orderkey > 5 OR o_custkey < 9", SAME), ("not_", "NOT o_orderkey = 5", SAME),
        ("ilike", "o_orderpriority ILIKE '%urg%'", SAME), ("in_", "o_orderstatus IN ('F', 'P')", SAME), ("isnan", "isnan(o_totalprice)", SAME), ("isnotnull", "isnotnull(nullif(o_orderstatus, 'F'))", "nullif(o_orderstatus, 'F') IS NOT NULL"), ("isnull", "isnull(nullif(o_orderstatus, 'F'))", "nullif(o_orderstatus, 'F') IS NULL"), ("like", "o_orderpriority LIKE '1-%'", SAME), ("like_escape", "'a%b' LIKE 'a#%b' ESCAPE '#'", SAME), ("like_any", "o_orderpriority LIKE ANY ('1-%', '2-%')", "o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%'"), ("like_all", "o_orderpriority LIKE ALL ('%U%', '1%')", "o_orderpriority LIKE '%U%' AND o_orderpriority LIKE '1%'"),
        ("regexp", "regexp(o_orderpriority, '^[12]-')", "regexp_matches(o_orderpriority, '^[12]-')"), ("regexp_like", "regexp_like(o_orderpriority, 'GH$')", "regexp_matches(o_orderpriority, 'GH$')"), ("rlike", "o_orderpriority RLIKE '[A-Z]{4}'", "regexp_matches(o_orderpriority, '[A-Z]{4}')"), ("between", "o_orderkey BETWEEN 5 AND 9", SAME), ("is_true", "(o_orderkey > 5) IS TRUE", SAME), ("is_unknown", "(nullif(o_orderkey, 5) > 5) IS UNKNOWN", "(nullif(o_orderkey, 5) > 5) IS NULL"), ("is_distinct", "nullif(o_orderkey, 5) IS DISTINCT FROM 6", SAME), ("similar_to", "similar_to(o_orderpriority, '(1|2)-%')", "regexp_full_match(o_orderpriority, '(1|2)-.*')"),
    ]),
    "string": ("part", "p_partkey", [
        ("ascii", "ascii(p_name)", SAME), ("base64", "base64(p_name)", "to_base64(p_name::BLOB)"), ("bit_length", "bit_length(p_name)", "bit_length(p_name)"), ("btrim", "btrim(concat('  ', p_name, ' '))", "p_name"), ("char", "char(65 + p_size % 26)", "chr((65 + p_size % 26)::INT)"), ("char_length", "char_length(p_name)", "length(p_name)"), ("character_length", "character_length(p_name)", "length(p_name)"), ("chr", "chr(97 + p_size % 26)", "chr((97 + p_size % 26)::INT)"), ("concat_ws", "concat_ws('|', p_name, NULL, p_brand)", SAME), ("contains", "contains(p_name, 'a')", SAME),
        ("decode", "decode(encode(p_name, 'UTF-8'), 'UTF-8')", "p_name"), ("elt", "elt(2, p_name, p_brand)", "p_brand"), ("encode", "hex(encode(p_brand, 'UTF-8'))", "hex(p_brand)"), ("endswith", "endswith(p_brand, '1')", "ends_with(p_brand, '1')"), ("find_in_set", "find_in_set('b', 'a,b,c')", "2"), ("format_number", "format_number(p_retailprice, 2)", "printf('%.2f', p_retailprice)"), ("format_string", "format_string('%s-%d', p_brand, p_size)", "printf('%s-%d', p_brand, p_size)"), ("initcap", "initcap(lower(p_brand))", "upper(left(lower(p_brand), 1)) || substr(lower(p_brand), 2)"), ("instr", "instr(p_name, 'a')", SAME), ("is_valid_utf8", "is_valid_utf8(p_name)", "true"),
        ("lcase", "lcase(p_brand)", SAME), ("left", "left(p_brand, 3)", SAME), ("len", "len(p_name)", SAME), ("length", "length(p_name)", SAME), ("levenshtein", "levenshtein(p_name, p_type)", SAME), ("locate", "locate('a', p_name, 3)", "CASE WHEN instr(substr(p_name, 3), 'a') = 0 THEN 0 ELSE instr(substr(p_name, 3), 'a') + 2 END"), ("lower", "lower(p_brand)", SAME), ("lpad", "lpad(p_brand, 12, '*')", SAME), ("ltrim", "ltrim(concat('  ', p_name))", "p_name"), ("luhn_check", "luhn_check('79927398713')", "true"), ("make_valid_utf8", "make_valid_utf8(p_name)", "p_name"), ("mask", "mask('AbC-12')", "'XxX-nn'"),
        ("octet_length", "octet_length(p_name)", "strlen(p_name)"), ("overlay", "overlay(p_name PLACING '__' FROM 2)", "substr(p_name, 1, 1) || '__' || substr(p_name, 4)"), ("position", "position('a', p_name)", "instr(p_name, 'a')"), ("printf", "printf('%05d', p_size)", "printf('%05d', p_size)"), ("regexp_count", "regexp_count(p_name, '[aeiou]')", "len(regexp_extract_all(p_name, '[aeiou]'))"), ("regexp_extract", "regexp_extract(p_brand, '([0-9]+)', 1)", SAME), ("regexp_extract_all", "regexp_extract_all(p_name, '([a-z]+)', 1)", "regexp_extract_all(p_name, '([a-z]+)', 1)"), ("regexp_instr", "regexp_instr(p_brand, '[0-9]')", "length(regexp_extract(p_brand, '^[^0-9]*')) + 1"), ("regexp_replace", "regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"), ("regexp_substr", "regexp_substr(p_brand, '[0-9]+')", "regexp_extract(p_brand, '[0-9]+')"),
        ("repeat", "repeat(p_brand, 2)", SAME), ("replace", "replace(p_name, 'a', 'A')", SAME), ("reverse", "reverse(p_name)", SAME), ("right", "right(p_brand, 2)", SAME), ("rpad", "rpad(p_brand, 12, '*')", SAME), ("rtrim", "rtrim(concat(p_name, '  '))", "p_name"), ("sentences", "size(sentences('Hi there. Bye now.'))", "2"), ("soundex", "soundex('Miller')", "'M460'"), ("space", "length(space(3))", "3"), ("split", "split(p_name, ' ')", "string_split(p_name, ' ')"), ("split_part", "split_part(p_name, ' ', 1)", SAME), ("startswith", "startswith(p_brand, 'B')", "starts_with(p_brand, 'B')"), ("substr", "substr(p_name, 2, 3)", SAME), ("substring", "substring(p_name FROM 2 FOR 3)", "substr(p_name, 2, 3)"), ("substring_zero", "substring('abc', 0, 2)", "'ab'"), ("substring_index", "substring_index('a.b.c', '.', 2)", "'a.b'"),
        ("to_binary", "hex(to_binary('abc', 'utf-8'))", "'616263'"), ("to_char", "to_char(p_size, '999')", "lpad(p_size::VARCHAR, 3, ' ')"), ("to_number", "to_number('1,234.5', '9,999.9')", "1234.5"), ("to_varchar", "to_varchar(p_size, '999')", "lpad(p_size::VARCHAR, 3, ' ')"), ("translate", "translate(p_name, 'abc', 'xyz')", SAME), ("trim", "trim(BOTH '*' FROM concat('**', p_brand, '*'))", "p_brand"), ("try_to_binary", "try_to_binary('zz', 'hex') IS NULL", "true"), ("try_to_number", "try_to_number('x', '999') IS NULL", "true"), ("try_validate_utf8", "try_validate_utf8(p_name)", "p_name"), ("ucase", "ucase(p_name)", SAME), ("unbase64", "cast(unbase64(base64(p_name)) AS string)", "p_name"), ("upper", "upper(p_name)", SAME), ("validate_utf8", "validate_utf8(p_name)", "p_name"), ("strpos", "strpos(p_name, 'a')", "instr(p_name, 'a')"),
    ]),
    "struct": ("part", "p_partkey", [("named_struct", "named_struct('a', p_size).a", "p_size"), ("struct", "struct(p_size AS x, p_name AS y).y", "p_name")]),
    "url": ("part", "p_partkey", [
        ("parse_url", "parse_url('http://userinfo@spark.apache.org/path?query=1#Ref', 'HOST')", "'spark.apache.org'"), ("parse_query", "parse_url(concat('http://h/p?q=', p_size), 'QUERY', 'q')", "p_size::VARCHAR"), ("url_decode", "url_decode(url_encode(p_name))", "p_name"), ("url_encode", "url_encode(p_name)", "replace(url_encode(p_name), '%20', '+')"),
    ]),
    "xml": ("part", "p_partkey", [
        ("xpath", "xpath('<a><b>b1</b><b>b2</b></a>', 'a/b/text()')", "['b1', 'b2']"), ("xpath_boolean", "xpath_boolean(concat('<a><b>', p_size, '</b></a>'), 'a/b = 2')", "p_size = 2"), ("xpath_double", "xpath_double(concat('<a>', p_size, '</a>'), 'sum(a)')", "p_size::DOUBLE"), ("xpath_float", "xpath_float(concat('<a>', p_size, '</a>'), 'sum(a)')", "p_size::FLOAT"), ("xpath_int", "xpath_int(concat('<a>', p_size, '</a>'), 'sum(a)')", "p_size"), ("xpath_long", "xpath_long(concat('<a>', p_size, '</a>'), 'sum(a)')", "p_size::BIGINT"), ("xpath_number", "xpath_number(concat('<a>', p_size, '</a>'), 'sum(a)')", "p_size::DOUBLE"), ("xpath_short", "xpath_short('<a>3</a>', 'a')", "3::SMALLINT"), ("xpath_string", "xpath_string(concat('<a>', p_name, '</a>'), 'a')", "p_name"),
    ]),
}
