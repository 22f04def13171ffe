"""Texts that can't be read by one pattern: nesting in literals, patterns beside divisions, types with braces."""

import random

import pytest

from tessera.functions.lexer import blank
from tessera.functions.outline import LANGUAGES, definitions, family, functions, methods

AWKWARD = {
    "javascript": (
        r"""const deep = `a ${ { b: `c ${ [1, 2].map((x) => { return `}${x}{`; }) } d` } } e {`;
function patterns(a) {
  const one = /[/"'`{]+\/(?:x|y)/gi, two = a / 2 / 3, three = a.replace(/}/g, "{");
  if (/"/.test(a)) { return /\//; }
  return (a + 1) / 2; // "{
}
function after(x) { /* ` { */ return x++ / 2 / x; }
class Shop {
  static #open = /class No {/;
  get total() { return `${this.a ? `{${1}` : "}"}`; }
  async *walk() { for (const a of b) { yield a; } }
}
export const last = () => { if (x) { y(); } };
""",
        ["deep", "patterns", "after", "Shop", "last"],
        ["total", "walk"],
        {"patterns": 2, "after": 1, "total": 1, "walk": 2, "last": 2},
    ),
    "tsx": (
        """export function View(p: { a: string; b: () => void }): { c: number } | { d: Map<string, { e: number }> } {
  if (p.a) { return <p title="{">Don't stop {p.a} it's</p>; }
  return <br />;
}
export class Box<T extends { id: string }, U = Record<string, { x: T }>> extends Base<{ y: U }> implements I {
  run<K extends keyof T>(k: K, f: (a: T) => { z: K }): { v: T[K] } { for (;;) { } }
  stop(): void {}
}
interface Deep<T extends { a: 1 }> { b: T }
type F = (a: { b: 1 }) => { c: 2 };
function isText(x: unknown): x is { s: string } { return x ? true : false; }
""",
        ["View", "Box", "Deep", "F", "isText"],
        ["run", "stop"],
        {"View": 2, "run": 2, "stop": 1, "isText": 1},
    ),
    "java": (
        '''class A<T extends Comparable<? super T>> {
  String s = """
    class No { " \\""" {
    """; char q = '"', b = '{', c = '\\'';
  <K extends Comparable<K>> Map<K, List<T>> pick(Map<K, T> m) { if (s == "}") { } return null; }
  void stop() { /* } */ while (q != '}') { } }
}
enum E { X { void f() { } }, Y }
''',
        ["A", "E"],
        ["pick", "stop"],
        {"pick": 2, "stop": 2},
    ),
    "go": (
        """func Any(a interface{ Do() }, f func(x struct{ y int }) struct{ z int }) map[string]interface{} {
	s := `"{ func No() {`
	if a != nil { return nil }
	return map[string]interface{}{"}": '}'}
}
func Set() struct{ a int } { for { } }
func Map[K comparable, V any](m map[K]V) chan struct{} { return nil }
type T struct { a string "json:\\"{\\"" }
""",
        ["Any", "Set", "Map", "T"],
        [],
        {"Any": 2, "Set": 2, "Map": 1},
    ),
    "rust": (
        """/* a /* nested { */ still } */
fn raw<'a>(x: &'a str) -> &'a str { let s = r#"fn no() { " "#; let t = "two
lines {"; let b = b'{'; let q = '\\''; if x == "}" { s } else { t } }
impl<'a, T: Fn(&'a str) -> Vec<u8>> Tr<T> for P<'a> where T: Copy { fn go(&self) { loop { } } }
fn last() {}
""",
        ["raw", "Tr", "last"],
        [],
        {"raw": 2, "go": 2, "last": 1},
    ),
    "ruby": (
        """class Shop
  SQL = <<~ONE + <<-'TWO'
    if this is sql
    def no
  ONE
    class No
    TWO
  def add(item)
    x = %w[if def end [class]] + %q(while (true) do)
    y = "#{item.map { |i| "if #{i} \\"" }.join("end")} {"
    return if item =~ /end#\\/"/
    z = item.size / 2 # def no
    if z % 3 == 0 then puts ?" end
    while z > 0 do z -= 1 end
    "text" if z.class == Integer && !z.end?
  end
end
=begin
def no
=end
module M
  def self.go!(a) = a
end
def top(a)
  a.each do |x|
    puts x / 2, `ls "#{x}"`
  end
end
__END__
def no
end
""",
        ["Shop", "M", "top"],
        [],
        {"add": 3, "go!": 1, "top": 1},
    ),
}


@pytest.mark.parametrize("language", sorted(AWKWARD))
def test_awkward_texts(language):
    text, names, inner, complexity = AWKWARD[language]
    code = blank(text, family(language))
    assert len(code) == len(text) and all((a == b) or b == " " for a, b in zip(text, code))
    found = definitions(text, language)
    assert [d.name for d in found] == names
    assert [m.name for d in found if d.body for m in methods(text, language, d.body)] == inner
    got = {name: n for name, _, n in functions(text, language)}
    assert {k: got.get(k) for k in complexity} == complexity


@pytest.mark.parametrize("language", sorted(set(LANGUAGES.values()) - {"python"}))
def test_any_text_has_a_result(language):
    """Random cuts and mixtures of signs: same length, same line breaks, definitions in order inside the text."""
    rng = random.Random(language)
    signs = ["`", "${", "}", "{", "'", '"', "/", "//", "/*", "*/", "#{", "%w[", "%(", "]", ")", "(", "<<~A\n", "\nA\n", "r#\"", '"#', "\\", "\n", " a ", "class X", "def f", "=begin\n", "?", "<", ">", "fn f", "function g", "=> {", "é", "\U0001f600"]
    for _ in range(150):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 60)))
        code = blank(text, family(language))
        assert len(code) == len(text) and [c == "\n" for c in code] == [c == "\n" for c in text]
        found = definitions(text, language)
        assert all(0 <= a.start <= a.end <= len(text) for a in found) and [d.start for d in found] == sorted(d.start for d in found)
        assert all(n >= 1 for _, _, n in functions(text, language))


def test_deep_nesting_and_long_texts():
    assert len(blank('"#{' * 3000, "ruby")) == 9000 and len(blank("`${" * 20000 + "}`" * 20000, "javascript")) == 100000
    assert [d.name for d in definitions("var x = `${`${`{`}`}`;\n" * 2000 + "function f() { }\n", "javascript")] == ["f"]


def test_a_text_with_classes_is_read_once(monkeypatch):
    from tessera.functions import lexer, outline
    from tessera.operators.chunks import chunk_file

    read, plain = [], lexer.blank
    monkeypatch.setattr(lexer, "blank", lambda *a: read.append(a) or plain(*a))
    code = "class A {\n  m() { return `}{`; }\n}\nclass B {\n  n() { return 1; }\n}\n"
    outline._read.cache_clear()
    assert [r[4] for r in chunk_file("a.js", code)] == ["m", "n"] and len(read) == 1


def test_parts_in_few_row_groups_are_many_tasks(spark, tmp_path):
    from tessera.plans import catalogue

    spark.range(200).selectExpr("id p_partkey", "cast(id % 50 as int) p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = catalogue.definition_chunks(spark, str(tmp_path))
    assert made.select("source").distinct().count() == 800 and made.rdd.getNumPartitions() > 1
