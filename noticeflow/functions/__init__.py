"""Column functions: dates, text, codes and URLs. Built-in expressions only."""
