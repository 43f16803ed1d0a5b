"""Reading and writing: snapshots, master, reports, web pages."""
