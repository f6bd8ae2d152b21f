import os
import subprocess
import sys


def test_results_survive_tasks_that_are_run_again():
    script = os.path.join(os.path.dirname(__file__), "flaky_job.py")
    done = subprocess.run(
        [sys.executable, script], capture_output=True, text=True, timeout=300
    )
    assert "reruns ok" in done.stdout, done.stderr[-3000:]
