"""webquarry: contact and crawl analytics as Spark DataFrame jobs."""
