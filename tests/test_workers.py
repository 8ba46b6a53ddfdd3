import subprocess
import sys

from pyspark import cloudpickle

from tsforge.operators.arima import solve_blocks
from tsforge.operators.stats import _dickey_fuller_fit, square_matrices


def test_worker_functions_need_no_installed_package(tmp_path):
    f = tmp_path / "f.pickle"
    f.write_bytes(cloudpickle.dumps((square_matrices, solve_blocks, _dickey_fuller_fit)))
    code = f"import pickle; print(len(pickle.load(open({str(f)!r}, 'rb'))))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "3", done.stderr
