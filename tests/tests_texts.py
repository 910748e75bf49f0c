"""Odd module texts: strings and brackets over would-be beginnings, names bound before, words of special meaning."""

ODD = [
    "x = '''\ndef f(): a()\nclass C: b()\n'''\ndef g(): c()\n",
    "x = (\ndef f(): a()\n)\n",
    "if a:\ndef f(): pass\n",
    "try:\n    a()\ndef f(): b()\n",
    "@deco(1)\ndef f(): a()\n@other\n@more(\n)\nclass C: b()\ndef g(): c()\n",
    "import make_3 as f_4, go\nfrom . import item\nfrom .. import run_2 as g1\ndef f(): item.run(); go()\ndef g(): go.x(); item()\n",
    "item = Thing()\nbox: Other.Kind = None\ndef f(): item.run(); box.open()\ndef g(a: item, self=1): a.b(); self.c()\n",
    "class A:\n    def m(self):\n        self.x = B()\n        self.x.go()\nclass A:\n    def n(self): self.x.go(); cls.y()\nclass A:\n    def o(self): self.x.go()\n",
    "def f(): a()\ndef f(): b()\ndef g(): c()\ndef f(x): d()\n",
    "match = 1\ndef match(case): case()\ndef type(a): match(a)\ndef _(b): _()\nclass r: f = rb(1)\ndef h(): return rb'x'.join(Rb'y' + u'z')\n",
    "def f(a):  # type: (int) -> str\n    x = a  # type: ignore\n    return g(x)  # type: int\ndef h(b):  # type: ignored\n    k()\n",
    "def f(x=1.e5, y=0x1F, z=1_0j): a(1if x else b())\ndef g(x=1.e6): a(2 .real())\n",
    "def f(): a('x\\ny')\ndef g(): b(\"it's\", '%s %d%%')\n",
    "def f():\n\ta()\ndef g():\n\tb()\n",
    "def caf\u00e9(): a()\ndef g(): '''\u00e9'''; b()\n",
    "def f(): a()\n\x0cdef g(): b()\ndef h(): c()\r\ndef i(): d()\n",
    "async def f(): await a()\nasync def g(): await b()\nclass C[T]: x: 'C.D[T]' = make()\ntype X = Y\ndef h[T](a: T): a.b()\n",
    "def f(): a()\ndef broken(:\n",
    "def f(): a()\nreturn\ndef g(): b() \\\n",
    "def f(): a()\nx = (1\ndef g(): b()\n",
    "def f(): from .near import a; a()\ndef g(): from .far import b; b()\n",
    "",
]
