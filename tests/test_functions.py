"""Worked cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from quern.functions import paths, text


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


TEMPLATES = [
    ("/users/123/orders/456/items/789", "/users/{userId}/orders/{orderId}/items/{itemId}"),
    ("/items/123/456", "/items/{itemId}/{id}"),
    ("/products/ABC123", "/products/{productCode}"),
    ("/events/2024-01-15", "/events/{eventDate}"),
    ("/events/2024-01-15T10:00:00Z", "/events/{eventTimestamp}"),
    ("", "/"),
    ("/?key=value", "/"),
    ("/api/v1/users/", "/api/v1/users"),
    ("/users/{userId}/x", "/users/{userId}/x"),
    ("/123", "/{id}"),
    ("/orders/550e8400-e29b-41d4-a716-446655440000?x=1", "/orders/{orderId}"),
    ("/status/7", "/status/{statuId}"),
    ("/responses/7", "/responses/{responseId}"),
    ("/categories/7", "/categories/{categoryId}"),
    ("/en/148.html", "/en/148.html"),
    ("/files/a_1-", "/files/{fileId}"),
]


def test_templates(spark):
    assert column(spark, [p for p, _ in TEMPLATES], paths.normalize_path) == [t for _, t in TEMPLATES]


def test_query_params(spark):
    got = column(spark, ["/a?x=1&y=a+b&x=2", "/a", "/a?", "/a?q=%C3%A9&bad=%zz"], paths.query_params)
    assert got == [{"x": "2", "y": "a b"}, None, None, {"q": "é", "bad": "%zz"}]


FORMATS = [
    ("550e8400-e29b-41d4-a716-446655440000", "uuid"),
    ("a@b.co", "email"),
    ("https://x", "uri"),
    ("2024-01-15T10:00:00.5Z", "date-time"),
    ("2024-01-15", "date"),
    ("999.1.1.1", "ipv4"),
    ("::1", "ipv6"),
    ("fe80::1:2", "ipv6"),
    ("2024-01-15\n", None),
    ("plain", None),
]


def test_formats(spark):
    assert column(spark, [v for v, _ in FORMATS], text.string_format) == [f for _, f in FORMATS]


def test_tools(spark):
    names = ["cp_create_cluster", "get_listener", "list_addresses", "ping"]
    assert column(spark, names, text.is_write_tool) == [True, False, False, False]
    assert column(spark, names, text.is_read_tool) == [False, True, True, False]
    assert column(spark, names, text.tool_resource) == ["cluster", "listener", "addresses", "ping"]
    assert column(spark, ["addresses", "entries", "routes", "class"], text.same_resource_key) == [
        "address",
        "entry",
        "route",
        "class",
    ]


@pytest.mark.parametrize(
    "case,want",
    [
        (("POST", "/users", "GET", "/users/{userId}", 500.0), "verification_loop"),
        (("POST", "/users", "GET", "/users/{userId}", 3000.0), "unknown"),
        (("POST", "/users", "GET", "/users", 9e9), "list_after_create"),
        (("POST", "/a/{aId}", "POST", "/a/{aId}/b", 0.0), "create_chain"),
        (("GET", "/a", "GET", "/a", 0.0), "unknown"),
    ],
)
def test_rest_patterns(spark, case, want):
    df = spark.createDataFrame([case], "a string, b string, c string, d string, e double")
    assert df.select(text.rest_pattern(*(F.col(c) for c in "abcde"))).first()[0] == want


def test_json_rpc(spark):
    bodies = [
        '{"jsonrpc":"2.0","method":"tools/call","params":{"name":"create_x"}}',
        '{"jsonrpc":"1.0","method":"initialize"}',
        '{"jsonrpc":"3","method":"x"}',
        '{"jsonrpc":"2.0","method":5}',
        "not json",
        None,
    ]
    assert column(spark, bodies, text.rpc_method) == ["tools/call", "initialize", None, None, None, None]
    assert column(spark, bodies, text.rpc_tool) == ["create_x", None, None, None, None, None]
    wrapped = '{"jsonrpc":"2.0","result":{"content":[{"type":"text","text":"{\\"id\\":1}"}]}}'
    assert column(spark, [wrapped, '{"id":2}'], text.unwrap_tool_response) == ['{"id":1}', '{"id":2}']


def test_headers(spark):
    headers = {"Authorization": "Bearer abc", "Cookie": "c", "Host": "h", "X-A": "1", "x-b": "", "Set-Cookie": "s"}
    df = spark.createDataFrame([(headers,)], "h map<string,string>")
    got = [tuple(x) for x in df.select(text.capture_headers(F.col("h"))).first()[0]]
    assert got == [("Authorization", "Bearer ***"), ("Cookie", "***"), ("Set-Cookie", "s"), ("X-A", "1")]


def test_names(spark):
    df = spark.createDataFrame(
        [("GET", "/users/{userId}", "404"), ("POST", "/users", "201"), ("GET", "/", "200")], "m string, p string, s string"
    )
    name = paths.schema_name(F.col("m"), F.col("p"), F.lit("response"), F.col("s"))
    assert [r[0] for r in df.select(name).collect()] == ["GetUsersUserIdResponse404", "PostUsersResponse201", "GetResponse"]
    assert column(spark, ["/users/{id}", "/x/addresses", "/{id}", "/api/entries"], paths.model_name) == [
        "User",
        "Address",
        "Model",
        "Entry",
    ]
