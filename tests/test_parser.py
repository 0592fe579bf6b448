import pytest

from trimodel.errors import QuerySyntaxError
from trimodel.lang import tree as t
from trimodel.lang.parser import parse, parse_expression
from trimodel.lang.tokens import tokenize


def one(text):
    (statement,) = parse(text)
    return statement


def kinds(text):
    return [k.kind for k in tokenize(text)[0]]


def test_tokens_of_a_line():
    tokens, errors = tokenize('get a.b from t where x >= 1.5 and y != "q" // rest')
    assert not errors
    assert [k.text for k in tokens[:12]] == ["get", "a", ".", "b", "from", "t", "where", "x", ">=", "1.5", "and", "y"]
    assert tokens[9].kind == "number" and tokens[13].kind == "string"


def test_indentation_makes_blocks():
    assert kinds("a\n  b\n    c\nd").count("indent") == 2
    assert kinds("a\n  b\n    c\nd").count("dedent") == 2
    assert kinds("a\n\tb\n    c").count("indent") == 1  # a tab counts four columns


def test_lines_inside_brackets_go_on():
    assert one("get from t where a in [1,\n  2,\n3]").where == one("get from t where a in [1, 2, 3]").where


def test_comments_and_blank_lines_are_skipped():
    assert one("// first\n\nget from t\n  // inside\n\n  take 1\n").take == 1


def test_unterminated_string_is_an_error():
    with pytest.raises(QuerySyntaxError):
        parse('get from t where a = "x')


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("get from users", t.Get("users")),
        ("get name, email from users", t.Get("users", columns=(t.Path(("name",)), t.Path(("email",))))),
        ("get profile.name from users", t.Get("users", columns=(t.Path(("profile", "name")),))),
        ("get from users as u", t.Get("users", "u")),
        ("get from app.users", t.Get("app.users")),
        ("get from users take 10", t.Get("users", take=10)),
        ("get from users skip 20", t.Get("users", skip=20)),
        ("get from users take $1 skip :n", t.Get("users", take=t.Param(1), skip=t.Param("n"))),
        ("get from users order by a, b desc", t.Get("users", order=(t.Order(t.Path(("a",))), t.Order(t.Path(("b",)), True)))),
        ("get from a cross join b", t.Get("a", joins=(t.Join("cross", "b", None, None),))),
        ("count from users", t.Count("users")),
        ("count users", t.Count("users")),
        ("describe users", t.Describe("users")),
        ("use default", t.Use("default")),
        ("begin", t.Transaction("begin")),
        ("drop table users", t.DropTable("users")),
        ("drop index i on users", t.DropIndex("i", "users")),
        ("drop namespace n force", t.DropNamespace("n", True)),
        ('make namespace n description "d"', t.MakeNamespace("n", "d")),
        ("make unique index i on users(a, b)", t.MakeIndex("i", "users", ("a", "b"), True)),
        ("change table users rename to people", t.Alter("users", (("rename table", "people"),))),
    ],
)
def test_statements(text, want):
    assert one(text) == want


def test_clauses_in_one_line_or_in_a_block():
    line = one("get name from users where active = true order by name take 10 skip 5")
    block = one("get name from users\n  where active = true\n  order by name\n  take 10\n  skip 5\n")
    assert line == block and line.take == 10 and line.skip == 5


def test_joins():
    q = one("get from users left join posts as p on users.id = p.user_id")
    assert q.joins[0].kind == "left" and q.joins[0].alias == "p" and q.joins[0].on is not None
    q = one("get from users\n  join posts\n  on users.id = posts.user_id\n")
    assert q.joins[0].kind == "inner" and q.joins[0].on is not None
    with pytest.raises(QuerySyntaxError):
        parse("get from users join posts")


def test_where_block_is_a_conjunction():
    assert one("get from t\n  where\n    a = 1\n    b = 2\n").where == parse_expression("a = 1 and b = 2")


def test_put_inline_block_and_nested():
    assert one('put into users name = "A", age = 30').values == (("name", t.Literal("A")), ("age", t.Literal(30)))
    nested = one('put into users\n  name = "A"\n  home\n    city = "X"\n    at\n      lat = 1.5\n')
    assert nested.values[1] == ("home", t.ObjectOf((("city", t.Literal("X")), ("at", t.ObjectOf((("lat", t.Literal(1.5)),))))))


def test_change_and_remove():
    q = one('change users where id = 1 name = "Bob"')
    assert q.where == parse_expression("id = 1") and q.values == (("name", t.Literal("Bob")),)
    assert one("change users n += 2").values == (("n", parse_expression("n + 2")),)
    assert isinstance(one("remove from users where id = 1"), t.Remove)
    with pytest.raises(QuerySyntaxError):
        parse("remove from users")


def test_make_table():
    q = one('make table users\n  as relational\n  fields\n    id bigint primary key\n    name text required\n    email text unique default "x"\n    tags [text]\n    kind\n')
    assert q.model == "relational" and [c.name for c in q.columns] == ["id", "name", "email", "tags", "kind"]
    assert q.columns[0].primary and q.columns[1].required and q.columns[2].unique and q.columns[2].default == t.Literal("x")
    assert [c.type for c in q.columns] == ["int64", "string", "string", "array", "string"]
    assert one("make table s\n  as keyspace\n  ttl 3600\n").ttl == 3600
    assert one("make table p\n  as document\n").columns == ()


def test_alter_block():
    q = one("change table t\n  add\n    a int default 0\n  drop\n    b\n  rename\n    c to d\n  alter\n    e set default 1\n    f type bigint\n    g required\n    h remove default\n    i nullable\n")
    assert [s for s, _ in q.steps] == ["add", "drop", "rename", "default", "type", "required", "no default", "nullable"]


@pytest.mark.parametrize(
    ("text", "same"),
    [
        ("a + b * c", "a + (b * c)"),
        ("a * b + c", "(a * b) + c"),
        ("a or b and c", "a or (b and c)"),
        ("a = b and c = d", "(a = b) and (c = d)"),
        ("a < b = c", "(a < b) = c"),
        ("a + b > c", "(a + b) > c"),
        ("a - b - c", "(a - b) - c"),
        ("not a = b", "not (a = b)"),
        ("a contains b", "a has b"),
    ],
)
def test_precedence(text, same):
    assert parse_expression(text) == parse_expression(same)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("42", t.Literal(42)),
        ("4.5", t.Literal(4.5)),
        ('"x"', t.Literal("x")),
        ("true", t.Literal(True)),
        ("null", t.Literal(None)),
        ("$1", t.Param(1)),
        ("$name", t.Param("name")),
        (":name", t.Param("name")),
        ("a.b.c", t.Path(("a", "b", "c"))),
        ("now()", t.Call("now", ())),
        ("date(x)", t.Call("date", (t.Path(("x",)),))),
        ("[1, 2]", t.ArrayOf((t.Literal(1), t.Literal(2)))),
        ("[]", t.ArrayOf(())),
        ("{a = 1}", t.ObjectOf((("a", t.Literal(1)),))),
        ("a is not null", t.Unary("is not null", t.Path(("a",)))),
    ],
)
def test_primary(text, want):
    assert parse_expression(text) == want


def test_words_are_names_where_no_keyword_is_due():
    q = one('get text, type, date, count from documents where text has "x" order by date')
    assert [c.name for c in q.columns] == ["text", "type", "date", "count"]


def test_several_errors_are_reported():
    with pytest.raises(QuerySyntaxError) as e:
        parse("remove from a\nget from b\nget from c where\n")
    assert len(e.value.errors) == 2


def test_a_statement_may_follow_a_block():
    made = "make table users\n  as relational\n  fields\n    id bigint primary key\n"
    found = parse(made + "make index if not exists i on users(id)\n" + made.replace("users", "if not exists more") + "drop table if exists users\n")
    assert [getattr(q, "quiet") for q in found] == [False, True, True, True]
