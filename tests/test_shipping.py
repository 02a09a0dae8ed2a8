"""Task functions are shipped by value: an isolated interpreter without this
package on its path can load and run them."""

import subprocess
import sys

from pyspark import cloudpickle

from docscope.operators.parse import parse_html

SCRIPT = """
import sys
from pyspark import cloudpickle
assert not any("docscope" in m for m in sys.modules)
parse = cloudpickle.loads(sys.stdin.buffer.read())
print(parse("<body><article>" + "word " * 40 + "</article></body>")["content_node"])
"""


def test_page_parser_runs_without_the_package():
    done = subprocess.run([sys.executable, "-I", "-c", SCRIPT], input=cloudpickle.dumps(parse_html),
                          capture_output=True, timeout=120)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
    assert done.stdout.decode().strip() == "article"
