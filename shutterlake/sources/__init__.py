"""Reading and writing: tables, inventories, timelines, images, snapshots."""
