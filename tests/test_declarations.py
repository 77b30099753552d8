"""The declaration lexer: what it finds in eleven languages, and that its time
follows the text."""

import time

import pytest

from recall_engine.operators.code_chunks import chunks_of
from recall_engine.operators.declarations import declarations

CASES = {}
CASES["typescript"] = '''// function no() {
export class UserService<T extends { id: string }> {
  private users: Map<string, User> = new Map();
  static s = `a } ${ [1, `{`].map(x => { return x }) } {`;

  constructor(private a: number) { super(); }

  async findUser(id: string): Promise<User | null> {
    const r = /[{}"]\\/{/g.test(id) ? a / b : c;
    return this.users.get(id) || null;
  }

  get size(): { n: number } {
    if (x) { y(); }
    return { n: 1 };
  }

  handler = (e: Event) => {
    go(e);
  };

  @Log()
  @Other({ a: 1 })
  deco<T>(x: T): void {
  }
}

function calculateTotal(items: Item[]): number {
  return items.reduce((sum, item) => sum + item.price, 0);
}

const formatCurrency = (amount: number): string => {
  return new Intl.NumberFormat('en-US', {
    style: 'currency',
  }).format(amount);
};
const inc = (x) => x + 1
const y = list.map(z => z * 2);
export interface User {
  id: string;
  go(): void;
}
type A = { a: string } | null;
enum Color { Red, Green }
export function processOrder(order: Order): { total: number } {
  return { ...order };
}
'''
CASES["java"] = '''package a.b;
import x.Y;
/** class Doc { } */
@Entity(name = "x{")
public class Calc<T> extends Base implements I {
  private int v = new Foo() { int g() { return 1; } }.g();
  static { init(); }
  public Calc(int v) { this.v = v; }
  @Override
  public <R> int add(int n)
      throws IOException {
    String s = "}" + '{' + """
      text } block "
    """;
    if (n > 0) { return n; } else { for (;;) { } }
  }
  abstract void none(int a);
  enum Kind { A, B { void q() {} } }
  interface In { int m(); }
}
record Point(int x, int y) { }
'''
CASES["csharp"] = '''using System;
namespace My.App
{
  public class Foo : Bar
  {
    #region x {
    public int Count { get; set; } = 3;
    public string Name => $"a{ b("}") } {{";
    string p = @"c:\\";
    public Foo(int a) : base(a) { }
    public async Task<int> RunAsync(string s)
    {
      var c = '{';
      return await Do(s);
    }
    int Twice(int x) => x * 2;
    #endregion
  }
  struct S { }
  interface IThing { void Go(); }
}
'''
CASES["kotlin"] = '''package a
/* outer /* { */ still } */
@Ann("x")
data class User(val id: Int) {
  val name = "a${ if (x) "}" else "{" }b"
  fun greet(): String {
    return """raw } { ${x}"""
  }
  fun short() = id + 1
  companion object {
    fun of(): User = User(1)
  }
}
fun <T> List<T>.second(): T = this[1]
fun main() {
  println('{')
}
object Single { }
interface Shape {
  fun area(): Double
  fun other(a: Int)
}
'''
CASES["go"] = '''package main
import "fmt"
type User struct {
	ID int // }
	F func() bool
}
type Shape interface { Area() float64 }
type Alias = int
func (u *User) Name() string {
	s := `raw } {`
	f := func(a int) int { return a }
	return "}" + string('{')
}
func main() {
	for i := 0; i < 3; i++ { fmt.Println(i) }
}
'''
CASES["rust"] = '''use a::b;
#[derive(Debug)]
pub struct Point<'a> { x: &'a str }
struct Unit;
enum E { A, B { c: i32 } }
/* a /* { */ b */
impl<'a> fmt::Display for Point<'a> {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {
        let c = '}'; let s = r#"{ " }"#;
        write!(f, "{}", "{")
    }
}
impl E { pub fn new() -> Self { E::A } }
trait T { fn must(&self); fn may(&self) { } }
mod inner { pub async fn go(f: impl Fn() -> i32) -> i32 { 1 } }
'''
CASES["php"] = '''<p>don't { </p>
<?php
namespace App\\Models;
// }
# {
#[Attr]
abstract class User extends Model {
  public function __construct(private int $a) { }
  public function name(): string {
    $s = "x {$a["k}"]} }"; $f = function ($x) { return $x; };
    return <<<EOT
 } text {
 EOT;
  }
  abstract protected function none();
}
interface I { public function a(); }
trait Tr { }
function helper(&$x) { return '}'; }
?> </html> {
'''
CASES["ruby"] = '''require "x"
=begin
class No
end
=end
module A
  class User < Base::Thing
    attr_reader :end, :class
    def initialize(a, b: 1)
      @a = a if a
      x = if b then 1 else 2 end
      while x < 3 do x += 1 end
      items.each do |i|
        puts "#{i.map { |z| "}" }} end" unless i
      end
      case x
      when 1 then foo
      end
      s = <<~EOS
        def heredoc
        end end
      EOS
      y = x / 2 / z
      r = /end\\/[\\/]/ =~ "def"
    rescue => e
      raise
    end
    def self.build(x) = new(x)
    def short = 1
    def ok?; true; end
    def value=(v)
      @v = v
    end
    class << self
      def inner; end
    end
  end
end
def top
  return if x
  begin; foo; end
  until done do; end
end
'''
CASES["scala"] = '''package a
/** class No { */
@ann class User(val id: Int) extends Base with Tr {
  def name: String = s"a${ "}" }b"
  def run(x: Int): Int = {
    val c = '}'
    x match { case 1 => 2 }
  }
  def abs(x: Int): Int
}
object Main extends App {
  def main(args: Array[String]): Unit =
    println("}")
}
trait T { def t: Int }
case class P(x: Int)
'''
CASES["swift"] = '''import A
/* a /* } */ b */
class User: Base {
  let s = "a \\(f("}")) {"
  init(a: Int) { self.a = a }
  func go<T>(x: T) -> String {
    let t = """
    } {
    """
    return t
  }
  class func make() -> User { User(a: 1) }
}
struct P { var x: Int { return 1 } }
protocol Q {
  func must()
  func other(a: Int) -> Int
}
extension User: Q { func must() { } }
enum E { case a, b }
func top() { if x { } else { } }
'''
CASES["javascript"] = '''class Calculator {
  constructor(initialValue = 0) {
    this.value = initialValue;
  }
  add(n) {
    if (n) { return } 
    this.value += n;
    return this;
  }
  #priv() { return 1 }
  static async *gen() { yield 1 }
  x = 1
  getResult() {
    return this.value;
  }
}
const f = async function named() { };
const g = async x => {
  return x
}
function* it() { }
module.exports = { Calculator, m() { }, class: 1 };
if (a) { function inner() { } }
'''
# (start line, end line, type, name, parent), read off the texts above
FOUND = {
    "typescript": [
        (2, 26, "class", 'UserService', ""),
        (6, 6, "method", 'constructor', "UserService"),
        (8, 11, "method", 'findUser', "UserService"),
        (13, 16, "method", 'size', "UserService"),
        (22, 25, "method", 'deco', "UserService"),
        (28, 30, "function", 'calculateTotal', ""),
        (32, 36, "function", 'formatCurrency', ""),
        (37, 37, "function", 'inc', ""),
        (39, 42, "interface", 'User', ""),
        (43, 43, "type", 'A', ""),
        (44, 44, "enum", 'Color', ""),
        (45, 47, "function", 'processOrder', ""),
    ],
    "java": [
        (4, 20, "class", 'Calc', ""),
        (8, 8, "method", 'Calc', "Calc"),
        (9, 16, "method", 'add', "Calc"),
        (17, 17, "method", 'none', "Calc"),
        (18, 18, "enum", 'Kind', "Calc"),
        (19, 19, "interface", 'In', "Calc"),
        (19, 19, "method", 'm', "In"),
        (21, 21, "class", 'Point', ""),
    ],
    "csharp": [
        (2, 21, "module", 'My.App', ""),
        (4, 18, "class", 'Foo', "My.App"),
        (7, 7, "property", 'Count', "Foo"),
        (8, 8, "property", 'Name', "Foo"),
        (10, 10, "method", 'Foo', "Foo"),
        (11, 15, "method", 'RunAsync', "Foo"),
        (16, 16, "method", 'Twice', "Foo"),
        (19, 19, "class", 'S', "My.App"),
        (20, 20, "interface", 'IThing', "My.App"),
        (20, 20, "method", 'Go', "IThing"),
    ],
    "kotlin": [
        (3, 13, "class", 'User', ""),
        (6, 8, "method", 'greet', "User"),
        (9, 9, "method", 'short', "User"),
        (10, 12, "class", 'Companion', "User"),
        (11, 11, "method", 'of', "Companion"),
        (14, 14, "function", 'second', ""),
        (15, 17, "function", 'main', ""),
        (18, 18, "class", 'Single', ""),
        (19, 22, "interface", 'Shape', ""),
        (20, 20, "method", 'area', "Shape"),
        (21, 21, "method", 'other', "Shape"),
    ],
    "go": [
        (3, 6, "class", 'User', ""),
        (5, 5, "method", 'bool', "User"),
        (7, 7, "interface", 'Shape', ""),
        (8, 8, "type", 'Alias', ""),
        (9, 13, "method", 'Name', ""),
        (11, 11, "method", 'int', ""),
        (14, 16, "function", 'main', ""),
    ],
    "rust": [
        (3, 3, "class", 'Point', ""),
        (4, 4, "class", 'Unit', ""),
        (5, 5, "enum", 'E', ""),
        (7, 12, "module", 'Point', ""),
        (8, 11, "method", 'fmt', "Point"),
        (13, 13, "module", 'E', ""),
        (13, 13, "method", 'new', "E"),
        (14, 14, "interface", 'T', ""),
        (14, 14, "method", 'must', "T"),
        (14, 14, "method", 'may', "T"),
        (15, 15, "module", 'inner', ""),
        (15, 15, "method", 'go', "inner"),
    ],
    "php": [
        (3, 3, "module", 'App\\Models', ""),
        (6, 16, "class", 'User', ""),
        (8, 8, "method", '__construct', "User"),
        (9, 14, "method", 'name', "User"),
        (15, 15, "method", 'none', "User"),
        (17, 17, "interface", 'I', ""),
        (17, 17, "method", 'a', "I"),
        (18, 18, "interface", 'Tr', ""),
        (19, 19, "function", 'helper', ""),
    ],
    "ruby": [
        (6, 38, "module", 'A', ""),
        (7, 37, "class", 'User', "A"),
        (9, 27, "method", 'initialize', "User"),
        (28, 28, "method", 'build', "User"),
        (29, 29, "method", 'short', "User"),
        (30, 30, "method", 'ok?', "User"),
        (31, 33, "method", 'value=', "User"),
        (35, 35, "method", 'inner', "User"),
        (39, 43, "function", 'top', ""),
    ],
    "scala": [
        (3, 10, "class", 'User', ""),
        (4, 4, "method", 'name', "User"),
        (5, 8, "method", 'run', "User"),
        (9, 9, "method", 'abs', "User"),
        (11, 14, "class", 'Main', ""),
        (12, 13, "method", 'main', "Main"),
        (15, 15, "interface", 'T', ""),
        (15, 15, "method", 't', "T"),
        (16, 16, "class", 'P', ""),
    ],
    "swift": [
        (3, 13, "class", 'User', ""),
        (5, 5, "method", 'init', "User"),
        (6, 11, "method", 'go', "User"),
        (12, 12, "method", 'make', "User"),
        (14, 14, "class", 'P', ""),
        (15, 18, "interface", 'Q', ""),
        (16, 16, "method", 'must', "Q"),
        (17, 17, "method", 'other', "Q"),
        (19, 19, "module", 'User', ""),
        (19, 19, "method", 'must', "User"),
        (20, 20, "enum", 'E', ""),
        (21, 21, "function", 'top', ""),
    ],
    "javascript": [
        (1, 16, "class", 'Calculator', ""),
        (2, 4, "method", 'constructor', "Calculator"),
        (5, 9, "method", 'add', "Calculator"),
        (10, 10, "method", 'priv', "Calculator"),
        (11, 11, "method", 'gen', "Calculator"),
        (13, 15, "method", 'getResult', "Calculator"),
        (17, 17, "function", 'named', ""),
        (18, 20, "function", 'g', ""),
        (21, 21, "function", 'it', ""),
        (23, 23, "function", 'inner', ""),
    ],
}


@pytest.mark.parametrize("language", CASES)
def test_declarations(language):
    got = [(c.start_line, c.end_line, c.chunk_type, c.name, c.parent) for c in declarations(CASES[language], language)]
    assert got == FOUND[language]


ODD = ["", "\n", "// only\n/* comments\n*/ // here", "function broken( {\n  // Missing\n  const x = \n", "}}}])", "'''", '"""', "class", "def", "`${`${", "@", "<?php", "é class 中 { }"]


@pytest.mark.parametrize("language", CASES)
@pytest.mark.parametrize("text", ODD)
def test_odd_texts(language, text):
    for c in declarations(text, language):
        assert 1 <= c.start_line <= c.end_line <= text.count("\n") + 1


def test_file_without_declarations_is_one_chunk():
    assert [x[:2] for x in chunks_of("// a\n// b", "typescript", 100, 125, 5)] == [(1, 2)]


def taken(text, language):
    began = time.process_time()
    found = declarations(text, language)
    return time.process_time() - began, found


MANY = [
    ("ruby", "def m{}(a)\n  a + 1\nend\n", ""), ("java", "class A{} {{\n", "}\n"), ("ruby", "class A{}\n", "end\n"), ("typescript", "const s{} = `${{`\n", ""), ("kotlin", "fun a a {}\n", ""),
    ("rust", "impl x {}\n", ""), ("typescript", "type a {}\n", ""), ("php", "function ({}\n", ""), ("ruby", "x %({}\n", ""),
]


@pytest.mark.parametrize(("language", "one", "close"), MANY)
def test_time_follows_the_text(language, one, close):
    make = lambda n: "".join(one.format(i) for i in range(n)) + close * n
    small, _ = taken(make(2000), language)
    large, found = taken(make(16_000), language)
    assert large < 24 * max(small, 0.02)
    if one.startswith(("def", "class")):
        assert len(found) == 16_000 and found[-1].end_line > found[-1].start_line
