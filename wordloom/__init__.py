"""wordloom — document representation and comparison on Spark DataFrames.

Every public function takes DataFrames (and plain keyword options) and
returns DataFrames; nothing data-sized is collected to the driver.
"""

__version__ = "0.1.0"
