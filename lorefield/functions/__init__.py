"""lorefield.functions"""
