import os


def test_readme_usage_example_runs(spark):
    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")).read()
    code = readme.split("## Using the library")[1].split("```python")[1].split("```")[0]
    ns = {"spark": spark}
    exec(code, ns)
    assert ns["by_decile"].count() == 10
    assert ns["dense"].count() == 100
