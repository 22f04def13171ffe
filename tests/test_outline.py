import pytest

from tessera.functions.outline import blank, definitions, functions, methods
from tessera.operators.chunks import chunk_file

TEXTS = {
    "javascript": """import x from 'y';
// function no() { if }
export default class Cart extends Base {
  #n = 1;
  static async add(item) { if (item) { for (const a of item) { f(a); } } return `if ${x}`; }
  get total() { return 0; }
}
export const go = async (a, b) => { while (a) { a--; } };
function plain(a) {
  const inner = x => x ? 1 : 2;
  switch (a) { case 1: break; case 2: break; default: }
  try { a() } catch (e) { }
}
let z = 5
console.log("hi {");
""",
    "typescript": """interface A { b: string }
type T = | 'a'
  | 'b';
export enum E { X }
@Injectable()
export class S { constructor(private a: A) {} run(): void; go<T>(x: T): T { return x; } }
export function f(x: number): number { return x > 1 ? 1 : 0; }
""",
    "java": """package a;
/** class No {} */
@Entity
public class A extends B<C> implements D {
  private int x = foo(1);
  public A(int x) throws E { this.x = x; }
  @Override public List<String> get(Map<String, Integer> m) { for (int i : m) { if (i > 0) {} } switch (x) { case 1: break; default: } return null; }
}
interface I { void f(); }
""",
    "go": """package main
type P struct {
 X int
}
func (p *P) Go(a int) (int, error) { select { case <-c: default: }; switch a { case 1: } ; switch y := x.(type) { case int: } ; if a > 0 { } ; return 1, nil }
func main() { fmt.Println("if {") }
var z = 1
""",
    "rust": """use a::b;
pub struct P { x: u8 }
impl<T: A> Tr for P { fn go(&self) -> u8 { match x { 1 if x > 2 => 1, _ => { if y { 2 } else { 3 } } } } }
pub(crate) async fn main<'a>(x: &'a str) { for i in 0..3 { let c = '{'; } loop { break; } }
enum E { A }
""",
    "ruby": """require "x"
# class No
class Cart < Base
  def add(item)
    return if item.nil?
    if item
      items.each do |x|
        puts x
      end
    elsif y
    end
  rescue E
  end
end
def top(a) ; a ; end
puts 1 if true
""",
}


@pytest.mark.parametrize(
    "language,names,inner,complexity",
    [
        ("javascript", ["Cart", "go", "plain", "z"], ["add", "total"], {"plain": 4, "add": 3, "go": 2, "total": 1}),
        ("typescript", ["A", "T", "E", "S", "f"], ["constructor", "run", "go"], {"constructor": 1, "run": 1, "go": 1, "f": 1}),
        ("java", ["A", "I"], ["A", "get"], {"get": 5, "A": 1, "f": 1}),
        ("go", ["P", "Go", "main"], [], {"Go": 6, "main": 1}),
        ("rust", ["P", "Tr", "main", "E"], [], {"go": 4, "main": 3}),
        ("ruby", ["Cart", "top"], [], {"add": 4, "top": 1}),
    ],
)
def test_definitions_and_branches(language, names, inner, complexity):
    text = TEXTS[language]
    found = definitions(text, language)
    assert [d.name for d in found] == names
    assert [m.name for d in found if d.body for m in methods(text, language, d.body)] == inner
    assert {name: n for name, _, n in functions(text, language)} == complexity
    code = blank(text, language)
    assert len(code) == len(text) and code.count("\n") == text.count("\n") and "No" not in code


def test_chunks_by_definition():
    rows = chunk_file("src/cart.js", TEXTS["javascript"])
    assert [(r[3], r[4], r[5], r[6]) for r in rows] == [("method", "add", "Cart", 5), ("method", "total", "Cart", 6), ("function", "go", "", 8), ("function", "plain", "", 9), ("function", "z", "", 14), ("module", "module_level", "", 1)]
    assert rows[0][1].startswith("# Class: Cart\nstatic async add") and "console.log" in rows[-1][1] and "import x" in rows[-1][1]
    assert chunk_file("a.go", "just words")[0][3] == "text" and chunk_file("a.rs", "}}} fn (((") and chunk_file("b.rb", "end\nend\ndef x")


@pytest.mark.parametrize("language", sorted(TEXTS))
def test_damaged_texts(language):
    for text in ("", "\n", "{", "}", "((((", "class", "class {", "def", "func", "fn x", "/* open", "'", '"', "`", "=> {", "function", TEXTS[language][: len(TEXTS[language]) // 2], TEXTS[language][::-1]):
        for d in definitions(text, language):
            assert 0 <= d.start <= d.end <= len(text)
            if d.body:
                assert all(m.start <= m.end for m in methods(text, language, d.body))
        assert all(n >= 1 for _, _, n in functions(text, language))


def test_chunks_are_handed_on_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    from tessera.operators import chunks

    texts = ["word " * n for n in (0, 10, 4000, 1, 9000)] * 60 + [None, " "]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["path", "content"])
    monkeypatch.setattr(chunks, "HELD", 20_000)
    made = list(chunks._rows(batch, 1500, 150))
    assert max(sum(len(r[1]) + 100 for r in rows) for rows in made) <= 20_000 + 1600 and len(made) > 100
    assert [r for rows in made for r in rows] == [r for i, t in enumerate(texts) if t and t.strip() for r in chunks.chunk_file(str(i), t)]
